"""Importing review decisions: all or nothing, against the report they were made on and the live groups."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from provena.operators import review
from provena.operators.tables import cut
from provena.plans.audit import open_workspace
from provena.plans.config import Config

FIELDS = {"groupId", "selectedImageId", "action", "selectedAt", "note"}


class ReviewError(ValueError):
    """Decisions that cannot be imported."""


def read_decisions(path: str) -> list[dict]:
    """A strict JSON list of decisions."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError) as e:
        raise ReviewError(f"{path}: {e}") from e
    if not isinstance(data, list):
        raise ReviewError(f"{path}: not a list")
    for n, d in enumerate(data):
        if not isinstance(d, dict) or set(d) - FIELDS:
            raise ReviewError(f"{path}: decision {n} has unknown fields")
        if not d.get("groupId") or d.get("action") not in review.ACTIONS or not d.get("selectedAt"):
            raise ReviewError(f"{path}: decision {n} needs groupId, selectedAt and a known action")
        if d["action"] in ("approve-recommendation", "select-different") and not d.get("selectedImageId"):
            raise ReviewError(f"{path}: decision {n} needs selectedImageId")
    return data


def decisions_path(workspace: str) -> str:
    return os.path.join(os.path.abspath(workspace), "decisions.json")


def stored_decisions(workspace: str) -> list[dict]:
    """Decisions imported so far; an unreadable file counts as none."""
    try:
        return read_decisions(decisions_path(workspace))
    except ReviewError:
        return []


def merge(existing: list[dict], incoming: list[dict]) -> list[dict]:
    """New decisions take the places of old ones on the same group; others follow."""
    new = {d["groupId"]: d for d in incoming}
    old = {d["groupId"] for d in existing}
    return [new.get(d["groupId"], d) for d in existing] + [d for d in incoming if d["groupId"] not in old]


def _frame(spark: SparkSession, decisions: list[dict]) -> DataFrame:
    return spark.createDataFrame([(d["groupId"], d.get("selectedImageId"), d["action"], d.get("note")) for d in decisions], "group_id string, selected_id string, action string, note string")


def import_file(spark: SparkSession, config: Config, path: str, force: bool = False) -> dict:
    """Applies valid decisions to the live groups.

    One invalid decision aborts everything; stale ones abort unless forced, and
    are then judged against the live groups alone.
    """
    decisions = read_decisions(path)
    ws = open_workspace(spark, config.workspace)
    groups = ws.read("groups")
    report = os.path.join(os.path.abspath(config.workspace), "audit.json")
    if groups is None or not os.path.exists(report):
        raise ReviewError("run an audit and a report first")
    with open(report, encoding="utf-8") as f:
        shown = [(g["id"], g["members"], g.get("recommendedOriginalId")) for g in json.load(f)["groups"]]
    snapshot = spark.createDataFrame(shown, "group_id string, members array<string>, recommended_id string")
    frame = _frame(spark, decisions)
    verdicts = cut(review.validate(frame, snapshot, groups), "verdicts")
    counts = {"valid": 0, "invalid": 0, "stale": 0} | {r["verdict"]: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
    if counts["stale"] and force and not counts["invalid"]:
        live = groups.select("group_id", "members", "recommended_id")
        verdicts = cut(review.validate(frame, live, live), "verdicts")
        counts = {"valid": 0, "invalid": 0, "stale": 0} | {r["verdict"]: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
    if counts["invalid"] or (counts["stale"] and not force):
        told = [f"{r['group_id']}: {r['reason']}" for r in verdicts.where("verdict <> 'valid'").orderBy("group_id").collect()]
        raise ReviewError("; ".join(told))
    valid = verdicts.where("verdict = 'valid'").select("group_id", "selected_id", "action", "note")
    ws.replace("groups", review.apply(groups, valid).select(*groups.columns))
    accepted = {r["group_id"] for r in valid.select("group_id").collect()}
    merged = merge(stored_decisions(config.workspace), [d for d in decisions if d["groupId"] in accepted])
    with open(decisions_path(config.workspace), "w", encoding="utf-8") as f:
        json.dump(merged, f, indent=2, ensure_ascii=False)
    return counts


__all__ = ["ReviewError", "import_file", "merge", "read_decisions", "stored_decisions"]
