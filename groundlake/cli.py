"""``python -m groundlake.cli ask|eval|resolve|health|export``: thin wrappers (OPS-1 to OPS-6)."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.prompts import SYSTEM, joined_passages, passage, rag_prompt
from . import schemas
from .operators import checks, encode, evaluate, generate, index, resolve, retrieve, runs
from .sources import readers


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="groundlake")
    ap.add_argument("--index", required=True)
    sub = ap.add_subparsers(dest="what", required=True)
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("-k", type=int, default=8)
    ask.add_argument("--show-passages", action="store_true")
    ask.add_argument("--provider", default="extractive", choices=generate.available_providers())
    ask.add_argument("--model")
    ask.add_argument("--retrieve-only", action="store_true")
    ask.add_argument("--guardrail", action="store_true")
    ev = sub.add_parser("eval")
    ev.add_argument("--gold")
    ev.add_argument("--providers", default="extractive")
    ev.add_argument("-k", type=int, default=8)
    ev.add_argument("--baseline", action="store_true")
    ev.add_argument("--max-tokens", type=int, default=generate.MAX_TOKENS)
    ev.add_argument("--limit", type=int)
    ev.add_argument("--ids", help="question ids, comma-separated")
    ev.add_argument("--conditions", help="conditions, comma-separated, instead of rag alone or --baseline")
    ev.add_argument("--show", type=int, default=20, help="flagged answers shown")
    ev.add_argument("--out")
    ev.add_argument("--report")
    ev.add_argument("--retrieve-only", action="store_true")
    res = sub.add_parser("resolve")
    res.add_argument("titles", nargs="*")
    res.add_argument("--stdin", action="store_true")
    res.add_argument("--gold")
    res.add_argument("--write", help="a folder for the resolved gold set")
    res.add_argument("--in-place", action="store_true", help="rewrite the gold file if a title resolves; the old one is kept as .old")
    exp = sub.add_parser("export")
    exp.add_argument("out")
    sub.add_parser("health")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    table = readers.index_table(spark, a.index)
    if a.what == "ask":
        if not a.question.strip():
            return 0
        backend = None if a.retrieve_only else generate.get_backend(a.provider, a.model)
        q = encode.encode(readers.arguments(spark, [a.question], "question"), "question", out_col="q_embedding", make=lambda: encode.HashingEncoder(encode.DIM))
        hits = retrieve.with_payload(retrieve.top_k(table, q, a.k), table.drop("embedding"), "chunk_id")
        shown = hits.withColumn("p", passage(F.col("rank"), F.col("score"), F.col("title"), F.col("paper_id"), F.col("year"), F.col("text")))
        row = shown.agg(joined_passages(F.col("rank"), F.col("p")).alias("passages"), F.collect_set("paper_id").alias("ids")).first()
        if a.show_passages or a.retrieve_only:
            print(row["passages"])
        if backend:
            user = spark.range(1).select(rag_prompt(F.lit(a.question), F.lit(row["passages"]))).first()[0]
            answer, grounded, _ = generate.generate_grounded(backend, SYSTEM, user, row["ids"], max_retries=generate.MAX_RETRIES if a.guardrail else 0)
            print(answer)
            if not grounded:
                print("warning: the answer cites what was not retrieved", file=sys.stderr)
        return 0
    if a.what == "eval":
        if not a.report:
            gold = readers.json_lines(spark, a.gold, schemas.GOLD, keep_broken=False)
            gold = gold.filter(F.col("qid").isin(a.ids.split(","))) if a.ids else gold
            gold = gold.orderBy("qid").limit(a.limit) if a.limit else gold
            if a.retrieve_only:
                total = evaluate.recall_total(evaluate.recall_preview(runs.preview(gold, table, k=a.k))).first()
                print(f"mean recall {total['mean_recall']}, questions {total['questions']}, with a miss {total['missed']}")
                return 0
            a.report = a.out or runs.default_path(datetime.now())
            conditions = tuple(a.conditions.split(",")) if a.conditions else runs.CONDITIONS if a.baseline else ("rag",)
            if set(conditions) - set(runs.CONDITIONS):
                ap.error(f"conditions are {', '.join(runs.CONDITIONS)}")
            runs.run(gold, table, a.providers.split(","), conditions=conditions, k=a.k, max_tokens=a.max_tokens).write.json(a.report)
        done = spark.read.schema(f"{schemas.RUN}, seq long").json(a.report)
        print(evaluate.markdown(evaluate.summary(done)))
        print("\n".join(r["line"] for r in evaluate.worst_first(evaluate.failures(done), a.show).collect()) or "nothing flagged")
        return 0
    if a.what == "resolve" and a.gold and a.in_place:
        changed = resolve.rewrite_gold(spark, a.gold, resolve.papers_of(table), schemas.GOLD)
        print("rewritten" if changed else "unchanged")
        return 0
    if a.what == "resolve" and a.gold:
        gold = readers.json_lines(spark, a.gold, schemas.GOLD, keep_broken=False)
        done = resolve.resolve_expected(gold, resolve.papers_of(table))
        if a.write:
            done.write.json(a.write)
        else:
            for r in done.select("qid", "expected_citations").orderBy("qid").collect():
                print(r["qid"], *r["expected_citations"])
        return 0
    if a.what == "resolve":
        titles = a.titles + ([x for x in sys.stdin.read().splitlines()] if a.stdin else [])
        for r in resolve.resolve(readers.arguments(spark, titles), resolve.papers_of(table)).orderBy("qid", "rank").collect():
            print(f"{titles[int(r['qid'])]}\t{r['band']}\t{r['score']:.2f}\t{r['paper_id']}\t({r['year']}) {r['title']}")
        return 0
    if a.what == "export":
        print(index.export_public(table, a.out))
        return 0
    papers = table.groupBy("paper_id").agg(F.first("title").alias("title"), F.first("year").alias("published"))

    def smoke():
        dim = table.select(F.size("embedding").alias("d")).first()
        q = encode.encode(readers.arguments(spark, ["what is this corpus about"], "question"), "question", out_col="q_embedding", make=lambda: encode.HashingEncoder(dim["d"]))
        return retrieve.with_payload(retrieve.top_k(table, q, 3), table.drop("embedding"), "chunk_id")

    around = checks.surroundings(spark, paths=(a.index,), keys=("ANTHROPIC_API_KEY", "OPENAI_API_KEY"), smoke=smoke)
    told = checks.report(papers, table, around).collect()
    for r in told:
        print(f"{r['status']:5}{r['check']}  {r['detail']}")
    return int(any(r["status"] == "FAIL" for r in told))


if __name__ == "__main__":
    sys.exit(main())
