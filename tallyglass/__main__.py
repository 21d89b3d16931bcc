"""Command line: ``python -m tallyglass opportunities ROOT ...`` and ``... search ROOT QUERY ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallyglass import sinks
from tallyglass.api import Engine
from tallyglass.plans.opportunities import RANKINGS
from tallyglass.plans.retrieval import parsed_filters


def main(argv: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="tallyglass", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    find = commands.add_parser("opportunities", help="rank accounts of a folder of tables")
    find.add_argument("root")
    find.add_argument("--topic", default="chronic_absenteeism")
    find.add_argument("--trend", default="worsening")
    find.add_argument("--rank-by", default="strict_action_funds", choices=RANKINGS)
    find.add_argument("--county")
    find.add_argument("--district")
    search = commands.add_parser("search", help="search the chunks of a folder of tables")
    search.add_argument("root")
    search.add_argument("query")
    search.add_argument("--filters", help="JSON object of field -> value")
    for p in (find, search):
        p.add_argument("--limit", type=int, default=10)
        p.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    engine = Engine.open(SparkSession.builder.getOrCreate(), args.root)
    if args.command == "opportunities":
        rows = engine.find_opportunities(args.topic, args.trend, args.rank_by, args.limit, county=args.county, district=args.district)
        shown = {"District": "district", "County": "county", "Rate": "current_status", "Change": "outcome_change", "Broad": "broad_action_funds", "Strict": "strict_action_funds", "Score": "opportunity_score"}
    else:
        rows = engine.search(args.query, args.limit, **parsed_filters(args.filters))
        shown = {"Chunk": "chunk_id", "District": "district", "Section": "section_type", "Score": "rrf_score"}
    out = sinks.envelope(rows, limit=args.limit) if args.json else sinks.markdown(rows, shown, args.limit)
    print(out)
    return out


if __name__ == "__main__":
    main()
