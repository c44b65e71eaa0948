"""Command line: profiles, validation and splitting of page files.

    python -m quire.plans.cli analyze categories DIR
    python -m quire.plans.cli analyze key-distributions DIR --keys category_type attribute.line
    python -m quire.plans.cli analyze relations|page-info|merge-list|null-order DIR
    python -m quire.plans.cli validate DIR --out DIR
    python -m quire.plans.cli data split-json FILE --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import profile, relations, validate
from quire.session import session
from quire.sources import pages as source
from quire.sources import sinks


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("what", choices=["categories", "key-distributions", "relations", "page-info", "merge-list", "null-order"])
    analyze.add_argument("dir", nargs="*")
    analyze.add_argument("--keys", nargs="*", default=["category_type"])
    check = commands.add_parser("validate")
    check.add_argument("dir", nargs="*")
    data = commands.add_parser("data")
    data.add_argument("what", choices=["split-json"])
    data.add_argument("dir", nargs=1)
    for p in (analyze, check, data):
        p.add_argument("--out")
    given = parser.parse_args(args)
    spark = session()
    pages = source.read_pages(spark, *given.dir, recursive=given.command != "analyze")
    if given.command == "data":
        sinks.write_files(sinks.split_pages(source.split_arrays(pages)), given.out)
        return
    out = validate.validate(pages) if given.command == "validate" else _profile(pages, given.what, given.keys)
    if given.out:
        sinks.write_csv(out, given.out, bom=True)
    else:
        _show(out)


#: Rows that are printed; --out writes all.
PRINTED = 1000


def _show(out: DataFrame) -> None:
    out.show(PRINTED, truncate=80)
    if (n := out.count()) > PRINTED:
        print(f"{PRINTED} of {n} rows; --out writes all")


def _profile(pages, what: str, keys: list[str]):
    if what == "categories":
        return profile.category_report(source.typed(source.nested_blocks(pages)))
    ann = source.annotations(pages)
    if what == "key-distributions":
        return profile.value_distribution(ann.select("file", "ann"), "ann", [k.split(".") for k in keys], "file").orderBy("path", F.desc("n"), "value")
    if what == "relations":
        return relations.patterns(relations.endpoints(source.relations(pages), ann)).orderBy(F.desc("n"), "relation_type", "category1", "category2")
    info = source.page_info(pages)
    if what == "page-info":
        listed = info.withColumn("special_issue", profile.issues("special_issue"))
        return profile.value_counts(listed, ["data_source", "language", "layout", "special_issue"]).orderBy("key", F.desc("n"), "value")
    if what == "merge-list":
        merged = ann.select("file", F.expr("coalesce(size(try_variant_get(ann, '$.merge_list', 'array<variant>')) > 0, false)").alias("merged"))
        sources = info.select("file", "data_source")
        return profile.share_by_group(sources.join(merged, "file", "left"), "data_source", "file", F.coalesce("merged", F.lit(False))).orderBy(F.desc("n"), "data_source")
    return profile.null_orders(ann).orderBy(F.desc("n"), "category")


if __name__ == "__main__":
    main()
