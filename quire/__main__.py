"""python -m quire ROOT add FILE [--reindex] | ask BOOK QUESTION | backfill-summaries | reindex-entities BOOK | list | delete BOOK | serve [PORT].

Models and their keys come from the environment (quire.plans.settings); ROOT may be - for QUIRE_ROOT.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quire.plans.clients import model_of
from quire.plans.engine import Engine
from quire.plans.settings import Settings
from quire.streaming.server import server


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("root")
    p.add_argument("command", choices=["add", "ask", "backfill-summaries", "reindex-entities", "list", "delete", "serve"])
    p.add_argument("values", nargs="*")
    p.add_argument("--reindex", action="store_true")
    a = p.parse_args(args)
    settings = Settings.load()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, settings.root if a.root == "-" else a.root, model_of(settings), settings.reader_chars, settings.readers)
    if a.command == "add":
        for b in engine.compile(a.values[0], a.reindex, lambda stage, state: print(f"{stage}: {state}")):
            print(b, engine.counts(b))
    elif a.command == "ask":
        print(engine.ask(*a.values).text)
    elif a.command == "backfill-summaries":
        print(engine.backfill_summaries())
    elif a.command == "reindex-entities":
        engine.reindex_entities(a.values[0])
    elif a.command == "delete":
        print(engine.delete(a.values[0]))
    elif a.command == "serve":
        server(engine, int(a.values[0]) if a.values else 8000).serve_forever()
    else:
        engine.books().show(truncate=False)


if __name__ == "__main__":
    main()
