"""The commands on a corpus and its ledger: python -m lodestone COMMAND PLACE ... Results are JSON lines; errors end with 2."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .corpus import Corpus, Ledger, evaluate
from .sources import side_inputs


def emit(rows: DataFrame) -> None:
    for line in rows.toJSON().toLocalIterator():  # one row at a time
        print(line)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("place", help="the folder of the corpus")
        for flags, kind in options:
            sub.add_argument(*flags.split(), **kind)

    many, flag, number = {"action": "append", "default": []}, {"action": "store_true"}, {"type": int}
    command("build", ("--paper", many), ("--process", many), ("--manifest", {}), ("--profile", {}))
    command("update", ("--verify-hash", flag))
    ways = [("--match", {"default": "all", "choices": ["all", "any", "phrase"]}), ("--raw", flag), ("--limit", number | {"default": 10})]
    command("search", ("queries", {"nargs": "+"}), *ways, ("--role", many), ("--journal", {}), ("--rescue", flag), ("--per-work", number | {"default": 2}), ("--pool", number | {"default": 1000}))
    command("passage-search", ("paper_id", {}), ("text", {}), *ways)
    command("inspect", ("--locator", {}), ("--paper-id", {}), ("--context", number | {"default": 1}))
    command("lookup", ("--doi", {}), ("--title", {}))
    for name in ("stats", "manifest-export", "companion-suggestions", "profile-audit"):
        command(name)
    command("citation-record", ("ledger", {}), ("--claim-id", {"required": True}), ("--claim-text", {"required": True}), ("--paper-id", {"required": True}), ("--locator", {"required": True}), ("--verdict", {"required": True}), ("--rationale", {"default": ""}))
    command("citation-audit", ("ledger", {}))
    command("benchmark", ("rows", {}), ("--k", number | many), ("--rescue", flag))
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = Corpus(spark, a.place)
    if a.command == "build":
        corpus.build(dict.fromkeys(a.paper, "PAPER") | dict.fromkeys(a.process, "PROCESS"), a.manifest, a.profile)
        emit(corpus.stats())
    elif a.command == "update":
        print(json.dumps(corpus.update(a.verify_hash)))
    elif a.command == "search":
        emit(corpus.search(a.queries, match=a.match, raw=a.raw, roles=a.role or None, journal=a.journal, limit=a.limit, per_work=a.per_work, rescue=a.rescue, pool=a.pool))
    elif a.command == "passage-search":
        emit(corpus.passage_search(a.paper_id, a.text, match=a.match, raw=a.raw, limit=a.limit))
    elif a.command == "inspect":
        emit(corpus.inspect(a.locator, a.paper_id, a.context))
    elif a.command == "lookup":
        emit(corpus.lookup(a.doi, a.title))
    elif a.command == "citation-record":
        emit(Ledger(corpus, a.ledger).record(a.claim_id, a.claim_text, a.paper_id, a.locator, a.verdict, a.rationale))
    elif a.command == "citation-audit":
        emit(Ledger(corpus, a.ledger).audit())
    elif a.command == "benchmark":
        found = evaluate(corpus, side_inputs.benchmark(spark, a.rows), tuple(a.k) or (20, 50), rescue=a.rescue)
        print(json.dumps(found | {"formulation_recall": [[*k, v] for k, v in found["formulation_recall"].items()]}))
    else:
        emit({"stats": corpus.stats, "manifest-export": corpus.export_manifest, "companion-suggestions": corpus.companion_suggestions, "profile-audit": corpus.profile_audit}[a.command]())


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        run(SparkSession.builder.getOrCreate(), a)
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
