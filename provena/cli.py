"""Command line: audit, report, review import, consolidate, rollback."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import os
import sys
from datetime import UTC, datetime

# Exit codes.
OK, FAILED, MANUAL_REVIEW, PARTIAL, INVALID_CONFIG, COLLISION = range(6)

log = logging.getLogger("provena")


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config")
    common.add_argument("--workspace")
    common.add_argument("--json", action="store_true", help="print results as JSON")
    common.add_argument("--verbose", action="store_true")
    common.add_argument("--quiet", action="store_true")
    top = argparse.ArgumentParser(prog="provena")
    sub = top.add_subparsers(dest="command", required=True)
    audit = sub.add_parser("audit", parents=[common], help="find copies and derivatives")
    audit.add_argument("inputs", nargs="*")
    audit.add_argument("--force", action="store_true", help="inspect unchanged files again")
    audit.add_argument("--no-perceptual", action="store_true")
    report = sub.add_parser("report", parents=[common], help="write the JSON and HTML report")
    report.add_argument("--absolute-paths", action="store_true")
    review = sub.add_parser("review", parents=[common], help="review decisions")
    review.add_argument("action", choices=["import"])
    review.add_argument("file")
    review.add_argument("--force", action="store_true", help="import stale decisions too")
    cons = sub.add_parser("consolidate", parents=[common], help="copy selected originals")
    cons.add_argument("--originals-directory")
    cons.add_argument("--apply", action="store_true")
    cons.add_argument("--dry-run", action="store_true")
    cons.add_argument("--yes", action="store_true")
    back = sub.add_parser("rollback", parents=[common], help="remove the copies of a run")
    back.add_argument("--run")
    back.add_argument("--apply", action="store_true")
    for name in ("references", "verify"):
        sub.add_parser(name, parents=[common], help="not implemented")
    return top


class JsonLines(logging.Formatter):
    """One JSON object a message."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname.lower(), "message": record.getMessage()})


def set_up_log(args) -> None:
    level = logging.DEBUG if args.verbose else logging.ERROR if args.quiet else logging.INFO
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if args.json else logging.Formatter("%(message)s"))
    log.handlers[:], log.propagate = [handler], False
    log.setLevel(level)


def resolve(args):
    """An explicit configuration file, else the one saved in the workspace, else the arguments alone."""
    from provena.plans import config

    saved = os.path.join(args.workspace or config.Config.workspace, "config.json")
    given = {"workspace": args.workspace, "originals_directory": getattr(args, "originals_directory", None)}
    if args.command == "audit":
        given["inputs"] = tuple(args.inputs) or None
        out = config.load_config(args.config, **given)
        if args.no_perceptual:
            out = dataclasses.replace(out, matching=dataclasses.replace(out.matching, perceptual_hash=False))
        os.makedirs(out.workspace, exist_ok=True)
        config.save_config(out, os.path.join(out.workspace, "config.json"))
        return out
    if args.config:
        return config.load_config(args.config, **given)
    found = config.read_saved(saved)
    if found is None:
        raise config.ConfigError(f"{saved} is missing or invalid; run an audit first or give --config")
    return dataclasses.replace(found, **{k: v for k, v in given.items() if v is not None})


def show(args, result: dict) -> None:
    if not args.quiet:
        print(json.dumps(result) if args.json else "\n".join(f"{k}: {v}" for k, v in result.items()))


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    set_up_log(args)
    from provena.plans.config import ConfigError

    if args.command in ("references", "verify"):
        log.error("%s is not implemented", args.command)
        return FAILED
    try:
        config = resolve(args)
    except (ConfigError, OSError, ValueError) as e:
        log.error("invalid configuration: %s", e)
        return INVALID_CONFIG
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("provena").getOrCreate()
    from provena.operators.tables import WorkspaceError
    from provena.plans import audit, consolidation, report, review

    try:
        if args.command == "audit":
            show(args, audit.run_audit(spark, config, args.force))
        elif args.command == "report":
            show(args, report.generate(spark, config, args.absolute_paths)["summary"])
        elif args.command == "review":
            show(args, review.import_file(spark, config, args.file, args.force))
        elif args.command == "consolidate":
            out = consolidation.consolidate(spark, config, args.apply)
            show(args, out)
            if out["collisions"]:
                return MANUAL_REVIEW if config.consolidation.collision_policy == "manual-review" else COLLISION
            return PARTIAL if out["failed"] else OK
        else:
            show(args, consolidation.roll_back(spark, config, args.run, args.apply))
    except consolidation.ConsolidationError as e:
        log.error("%s", e)
        return COLLISION if "collide" in str(e) else FAILED
    except (review.ReviewError, FileNotFoundError, report.InvalidReport, WorkspaceError) as e:
        log.error("%s", e)
        return FAILED
    return OK


if __name__ == "__main__":
    sys.exit(main())
