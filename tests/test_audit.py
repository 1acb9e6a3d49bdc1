"""The whole audit, report, review, consolidation and rollback on files made here."""

import json
import os

import numpy as np
import pytest

from provena.plans import audit, config
from provena.sources import pixels
from tests.test_pixels import checkerboard, noisy, shrunk, smooth


def save(path, plane):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = plane if plane.ndim == 3 else np.repeat(plane[:, :, None], 3, axis=2)
    with open(path, "wb") as f:
        f.write(pixels.encode_png(data))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    a = smooth(320)
    save(f"{root}/in/original.png", a)
    save(f"{root}/in/resized.png", shrunk(a, 160))
    save(f"{root}/in/rotated.png", a[::-1, ::-1])
    save(f"{root}/in/unrelated.png", checkerboard(320))
    save(f"{root}/in/backups/copy.png", a)
    save(f"{root}/in/crop.png", a[32:288, 32:288])
    save(f"{root}/in/small.png", noisy(120))
    save(f"{root}/in/fake.png", shrunk(noisy(120), 400))
    with open(f"{root}/in/broken.png", "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\nxx")
    with open(f"{root}/in/notes.txt", "w") as f:
        f.write("x")
    return root


@pytest.fixture(scope="module")
def done(spark, tree):
    c = config.load_config(inputs=(f"{tree}/in",), workspace=f"{tree}/ws", originals_directory=f"{tree}/out")
    first = audit.run_audit(spark, c)
    return c, first, audit.run_audit(spark, c)


def test_audit_counters_and_cache(done):
    _, first, second = done
    assert (first["candidates"], first["inspected"], first["cached"], first["errors"]) == (9, 8, 0, 1)
    assert (second["inspected"], second["cached"]) == (0, 8)  # the broken file is tried again
    assert first["exact_duplicate_manual_review"] == 1


def test_audit_relationships(spark, done):
    c, first, _ = done
    ws = audit.open_workspace(spark, c.workspace)
    names = {r["id"]: r["relative_path"] for r in ws.read("images").collect()}
    got = {frozenset((names[r["a"]], names[r["b"]])): r["relationship"] for r in ws.read("comparisons").collect()}
    assert got[frozenset(("original.png", "resized.png"))] == "resize"
    assert got[frozenset(("original.png", "rotated.png"))] == "rotation"
    assert got[frozenset(("original.png", "crop.png"))] == "crop"
    assert got.get(frozenset(("original.png", "unrelated.png")), "unknown") == "unknown"
    assert frozenset(("original.png", "backups/copy.png")) not in got
    flagged = {r["relative_path"] for r in ws.read("images").where("is_upscale").collect()}
    assert "fake.png" in flagged and "small.png" not in flagged  # a smooth texture gains nothing from more pixels either
    for r in ws.read("groups").where("kind = 'visual'").collect():
        assert len(r["members"]) >= 2 and r["status"] in ("automatic", "manual-review", "ambiguous")


def test_report_review_consolidate_rollback(spark, done, tree):
    from provena.plans import consolidation, report, review

    c, _, _ = done
    made = report.generate(spark, c)
    assert made["summary"]["exactDuplicateGroups"] == 1 and made["summary"]["errors"] >= 1
    data = json.load(open(f"{c.workspace}/report/data/report.json"))
    assert data["schemaVersion"] == 1 and [i["path"] for i in data["images"]] == sorted(i["path"] for i in data["images"])
    assert "absolutePath" not in data["images"][0]
    page = open(f"{c.workspace}/report/index.html").read()
    assert "Content-Security-Policy" in page and "<script" in page
    assert any(f.endswith(".png") for f in os.listdir(f"{c.workspace}/report/assets"))

    exact = next(g for g in data["groups"] if g["kind"] == "exact-duplicate")
    decisions = [{"groupId": exact["id"], "selectedImageId": exact["members"][0], "action": "select-different", "selectedAt": "2026-01-01T00:00:00Z"}]
    path = f"{tree}/decisions.json"
    json.dump(decisions, open(path, "w"))
    assert review.import_file(spark, c, path) == {"valid": 1, "invalid": 0, "stale": 0}
    json.dump([decisions[0] | {"groupId": "nope"}], open(path, "w"))
    with pytest.raises(review.ReviewError):
        review.import_file(spark, c, path)

    dry = consolidation.consolidate(spark, c, apply=False)
    assert dry["planned"] >= 1 and not os.path.exists(c.originals_directory)
    run = consolidation.consolidate(spark, c, apply=True)
    assert run["verified"] == dry["planned"] and run["failed"] == 0
    files = os.listdir(c.originals_directory)
    assert len([f for f in files if f.endswith(".png")]) == run["verified"]
    manifest = json.load(open(f"{c.originals_directory}/manifest.json"))
    assert [m["canonicalPath"] for m in manifest["images"]] == sorted(m["canonicalPath"] for m in manifest["images"])
    again = consolidation.consolidate(spark, c, apply=False)
    assert again["collisions"] == run["verified"]
    victim = f"{c.originals_directory}/{manifest['images'][0]['canonicalPath']}"
    with open(victim, "ab") as f:
        f.write(b"changed")
    assert consolidation.roll_back(spark, c, apply=False)["removed"] == run["verified"] - 1
    out = consolidation.roll_back(spark, c, apply=True)
    assert out["removed"] == run["verified"] - 1 and out["skipped"] == 1 and os.path.exists(victim)


def test_cli(spark, tree, capsys):
    from provena import cli

    assert cli.main(["audit", f"{tree}/in", "--workspace", f"{tree}/ws2", "--no-perceptual"], spark=spark) == 0
    assert "candidates" in capsys.readouterr().out
    assert cli.main(["audit", "--workspace", f"{tree}/ws2"], spark=spark) == cli.INVALID_CONFIG
    assert cli.main(["report", "--workspace", f"{tree}/ws2"], spark=spark) == 0
    assert cli.main(["rollback", "--workspace", f"{tree}/ws2"], spark=spark) == cli.FAILED
    for name in ("references", "verify"):
        assert cli.main([name, "--workspace", f"{tree}/ws2"], spark=spark) == cli.FAILED
