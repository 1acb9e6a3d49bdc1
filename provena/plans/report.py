"""The report: validated JSON, thumbnails and detail crops, and a static page for reviewing."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import provena
from provena.plans.audit import _rows, open_workspace, read_file
from provena.plans.config import Config, fingerprint

SCHEMA_VERSION = 1
METADATA = {"exifPresent": "exif", "iptcPresent": "iptc", "xmpPresent": "xmp", "iccPresent": "icc", "captureDate": "capture_date", "cameraMake": "camera_make", "cameraModel": "camera_model", "copyright": "copyright", "creator": "creator"}
# What must be escaped in HTML text.
HTML_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}


class InvalidReport(ValueError):
    """A report that breaks its own schema; it is not written."""


def escape_html(text: str) -> str:
    return "".join(HTML_ESCAPES.get(c, c) for c in text)


def script_json(value) -> str:
    """JSON that can stand inside a script element."""
    return json.dumps(value, ensure_ascii=False).replace("<", "\\u003c")


def repository_root(start: str) -> str | None:
    """The nearest folder upwards, within 30, that holds ``.git``."""
    here = os.path.abspath(start)
    for _ in range(30):
        if os.path.exists(os.path.join(here, ".git")):
            return here
        here = os.path.dirname(here)
    return None


def _image(r, absolute: bool, assets: dict) -> dict:
    out = {"id": r["id"], "path": r["relative_path"], "sha256": r["sha256"], "format": r["format"], "width": r["width"], "height": r["height"], "aspectRatio": r["aspect_ratio"], "hasAlpha": bool(r["has_alpha"]), "fileSizeBytes": r["size_bytes"]}
    out["metadata"] = {k: r[c] for k, c in METADATA.items() if r[c] is not None}
    out["quality"] = {"probableUpscale": True} if r["is_upscale"] else {}
    out["warnings"] = list(r["warnings"] or [])
    if absolute:
        out["absolutePath"] = r["real_path"]
    if r["bit_depth"] is not None:
        out["bitDepth"] = r["bit_depth"]
    if r["sha256"] in assets:
        out["assets"] = assets[r["sha256"]]
    return out


def _group(r, comparisons: list[dict]) -> dict:
    out = {"id": r["group_id"], "kind": r["kind"], "members": list(r["members"]), "comparisons": comparisons, "confidence": r["confidence"], "status": r["status"], "reasons": list(r["reasons"]), "warnings": list(r["warnings"])}
    if r["recommended_id"] is not None:
        out["recommendedOriginalId"] = r["recommended_id"]
    if r["score"] is not None:
        out["score"] = r["score"]
    return out


def group_edges(groups: DataFrame, comparisons: DataFrame | None) -> DataFrame:
    """(group_id, a, b, relationship, confidence, ...) among members: star edges of exact groups, confirmed ones of visual groups."""
    details = ("larger", "cropped", "retained", "box_left", "box_top", "box_width", "box_height")
    exact = groups.where("kind = 'exact-duplicate'").select("group_id", F.element_at("members", 1).alias("a"), F.explode(F.slice("members", 2, F.greatest(F.size("members"), F.lit(1)))).alias("b"))
    exact = exact.select("group_id", "a", "b", F.lit("exact-duplicate").alias("relationship"), F.lit(1.0).alias("confidence"), F.array(F.lit("identical SHA-256")).alias("reasons"))
    if comparisons is None:
        return exact
    m = groups.where("kind = 'visual'").select("group_id", F.explode("members").alias("m"))
    known = comparisons.where("relationship <> 'unknown'")
    visual = known.join(m.select("group_id", F.col("m").alias("a")), "a").join(m.select(F.col("group_id").alias("_g"), F.col("m").alias("b")), "b").where("group_id = _g")
    return exact.unionByName(visual.select("group_id", "a", "b", "relationship", "confidence", "reasons", *details), allowMissingColumns=True)


def _edge(r) -> dict:
    out = {"a": r["a"], "b": r["b"], "relationship": r["relationship"], "confidence": r["confidence"], "reasons": list(r["reasons"])}
    if "cropped" in r and r["cropped"] is not None:
        out["details"] = {"largerImageId": r["larger"], "croppedImageId": r["cropped"], "retainedArea": r["retained"], "cropBox": {k: r[f"box_{k}"] for k in ("left", "top", "width", "height")}}
    return out


def build(config: Config, records: list, groups: list[dict], errors: list, assets: dict | None = None, absolute: bool = False, generated_at: str | None = None) -> dict:
    images = sorted((_image(r, absolute, assets or {}) for r in records), key=lambda i: (i["path"], i["id"]))
    groups = sorted(groups, key=lambda g: g["id"])
    n = lambda **kw: sum(all(g[k] == v for k, v in kw.items()) for g in groups)
    listed = sorted(({"phase": e["phase"], "filePath": e["file_path"], "operation": e["operation"], "error": e["error"], "continued": e["continued"]} for e in errors), key=lambda e: (e["filePath"] or "", e["error"]))
    out = {
        "schemaVersion": SCHEMA_VERSION,
        "generatedAt": generated_at or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
        "toolVersion": provena.__version__,
        "configFingerprint": fingerprint(config),
        "config": dataclasses.asdict(config),
        "summary": {
            "filesDiscovered": len(images), "filesInspected": len(images), "exactDuplicateGroups": n(kind="exact-duplicate"), "visualGroups": n(kind="visual"), "manualReviewGroups": n(status="manual-review"),
            "ambiguousGroups": n(status="ambiguous"), "automaticRecommendations": n(status="automatic"), "errors": len(listed),
        },
        "images": images,
        "groups": groups,
        "errors": listed,
    }
    validate(out)
    return out


def validate(report: dict) -> None:
    """Raises InvalidReport with every broken rule."""
    bad = []
    if report["schemaVersion"] != SCHEMA_VERSION:
        bad.append("schemaVersion: unsupported")
    for i in report["images"]:
        if not re.fullmatch("[0-9a-f]{64}", i["sha256"]):
            bad.append(f"images.{i['id']}.sha256: not a SHA-256")
        if i["width"] <= 0 or i["height"] <= 0 or i["fileSizeBytes"] < 0:
            bad.append(f"images.{i['id']}: impossible size")
    for g in report["groups"]:
        if len(g["members"]) < 2:
            bad.append(f"groups.{g['id']}: fewer than two members")
        if "recommendedOriginalId" in g and g["recommendedOriginalId"] not in g["members"]:
            bad.append(f"groups.{g['id']}: the recommendation is no member")
        if g["status"] == "automatic" and g["kind"] == "visual" and "score" not in g:
            bad.append(f"groups.{g['id']}: an automatic recommendation without score")
    if bad:
        raise InvalidReport("; ".join(bad))


def _assets(folder: str):
    def run(row: dict) -> list[dict]:
        from provena.sources import pixels

        sha = row["sha256"]
        names = {k: f"assets/{sha}-{k}.png" for k in ("thumbnail", "centerCrop", "detailCrop")}
        if not all(os.path.exists(os.path.join(folder, n)) for n in names.values()):
            try:
                r = pixels.decode(read_file(row["real_path"]))
            except (OSError, ValueError):
                return []
            centre, detail = pixels.detail_crops(r)
            for k, a in (("thumbnail", pixels.thumbnail(r)), ("centerCrop", centre), ("detailCrop", detail)):
                target = os.path.join(folder, names[k])
                with open(f"{target}.{os.getpid()}", "wb") as f:
                    f.write(pixels.encode_png(a))
                os.replace(f"{target}.{os.getpid()}", target)
        return [{"sha256": sha} | names]

    return run


PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src 'none'; img-src 'self' data:; style-src 'unsafe-inline'; script-src 'unsafe-inline'">
<title>{title}</title><style>
body {{ font: 15px/1.5 system-ui, sans-serif; margin: 2rem auto; max-width: 70rem; }} section {{ border-top: 1px solid #999; padding: 1rem 0; }}
figure {{ display: inline-block; margin: .4rem; vertical-align: top; width: 15rem; }} img {{ max-width: 15rem; max-height: 12rem; }} .pick {{ outline: 3px solid #27c; }}
</style></head><body><h1>{title}</h1><p id="summary"></p>
<p><label>Least confidence <input id="least" type="number" min="0" max="1" step="0.05" value="0"></label> <label>Relationship <select id="rel"><option value="">all</option></select></label>
<label><input id="open" type="checkbox"> unresolved only</label> <button id="save">Save decisions</button></p><main id="groups"></main>
<script id="data" type="application/json">{data}</script><script>
"use strict";
const report = JSON.parse(document.getElementById("data").textContent), images = new Map(report.images.map(i => [i.id, i])), decisions = new Map();
const make = (tag, text) => {{ const e = document.createElement(tag); if (text !== undefined) e.textContent = text; return e; }};
const relations = new Set(report.groups.flatMap(g => g.comparisons.map(c => c.relationship)));
for (const r of [...relations].sort()) document.getElementById("rel").append(make("option", r));
document.getElementById("summary").textContent = Object.entries(report.summary).map(([k, v]) => k + ": " + v).join(", ");
const size = n => {{ const u = ["B", "KB", "MB", "GB"]; let i = 0; while (n >= 1024 && i < 3) {{ n /= 1024; i++; }} return n.toFixed(i ? 1 : 0) + " " + u[i]; }};
const decide = (id, change) => decisions.set(id, {{ groupId: id, action: "defer", ...decisions.get(id), ...change, selectedAt: new Date().toISOString() }});
const shown = g => g.confidence >= Number(document.getElementById("least").value)
  && (!document.getElementById("rel").value || g.comparisons.some(c => c.relationship === document.getElementById("rel").value))
  && (!document.getElementById("open").checked || !decisions.has(g.id) || decisions.get(g.id).action === "defer");
const draw = () => {{
  const root = document.getElementById("groups"); root.replaceChildren();
  for (const g of report.groups.filter(shown)) {{
    const s = make("section"); s.append(make("h2", g.kind + ", " + g.status + ", confidence " + g.confidence.toFixed(2)));
    for (const t of g.reasons) s.append(make("p", t)); for (const t of g.warnings) s.append(make("p", "Note: " + t));
    for (const id of g.members) {{
      const i = images.get(id); if (!i) continue; const f = make("figure");
      if (id === (decisions.get(g.id) || {{}}).selectedImageId || (!decisions.has(g.id) && id === g.recommendedOriginalId)) f.className = "pick";
      if (i.assets && i.assets.thumbnail) {{ const p = make("img"); p.src = i.assets.thumbnail; p.alt = i.path; f.append(p); }}
      f.append(make("figcaption", i.path + ", " + i.width + "x" + i.height + ", " + size(i.fileSizeBytes)));
      const b = make("button", "Keep this one"); b.onclick = () => {{ decide(g.id, {{ action: id === g.recommendedOriginalId ? "approve-recommendation" : "select-different", selectedImageId: id }}); draw(); }}; f.append(b); s.append(f);
    }}
    for (const a of ["keep-multiple", "not-related", "defer"]) {{ const b = make("button", a); b.onclick = () => {{ decide(g.id, {{ action: a, selectedImageId: undefined }}); draw(); }}; s.append(b); }}
    const n = make("input"); n.placeholder = "Note"; n.value = (decisions.get(g.id) || {{}}).note || ""; n.onchange = () => decide(g.id, {{ note: n.value }}); s.append(n); root.append(s);
  }}
}};
for (const id of ["least", "rel", "open"]) document.getElementById(id).onchange = draw;
document.getElementById("save").onclick = () => {{ const a = make("a"); a.href = "data:application/json," + encodeURIComponent(JSON.stringify([...decisions.values()], null, 2)); a.download = "decisions.json"; a.click(); }};
draw();
</script></body></html>
"""


def _write(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp", path)


def generate(spark: SparkSession, config: Config, absolute_paths: bool = False) -> dict:
    """Writes ``audit.json`` and the report folder; returns the report.

    The report is one document for a reader's browser, so the driver holds it.
    """
    ws = open_workspace(spark, config.workspace)
    images = ws.read("images")
    if images is None:
        raise FileNotFoundError(f"no audit has been run in {config.workspace}")
    groups, errors = ws.read("groups"), ws.read("scan_errors")
    folder = os.path.join(os.path.abspath(config.workspace), "report")
    os.makedirs(os.path.join(folder, "assets"), exist_ok=True)
    rows, assets = [], {}
    if groups is not None:
        grouped = images.join(groups.select(F.explode("members").alias("id")).distinct(), "id", "left_semi").groupBy("sha256").agg(F.min("real_path").alias("real_path"))
        made = _rows(grouped.repartition("sha256"), "sha256 string, thumbnail string, centerCrop string, detailCrop string", _assets(folder))
        assets = {r["sha256"]: {k: r[k] for k in ("thumbnail", "centerCrop", "detailCrop")} for r in made.collect()}
        edges: dict[str, list[dict]] = {}
        for r in group_edges(groups, ws.read("comparisons")).orderBy("group_id", "a", "b").collect():
            edges.setdefault(r["group_id"], []).append(_edge(r.asDict()))
        rows = [_group(r, edges.get(r["group_id"], [])) for r in groups.collect()]
    out = build(config, images.collect(), rows, [] if errors is None else errors.collect(), assets, absolute_paths)
    root = repository_root(config.workspace)
    if root:
        out["repositoryRoot"] = root if absolute_paths else os.path.basename(root)
    text = json.dumps(out, indent=2, ensure_ascii=False) + "\n"
    _write(os.path.join(os.path.abspath(config.workspace), "audit.json"), text)
    _write(os.path.join(folder, "data", "report.json"), text)
    _write(os.path.join(folder, "index.html"), PAGE.format(title=escape_html("Image provenance report"), data=script_json(out)))
    return out
