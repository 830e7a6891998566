"""Commands over a project: a folder with the book's tables as snapshots, a style text and a glossary.

    python -m quire.cli init BOOK [--dir PROJECT] [--chunk-chars N] [--force]
    python -m quire.cli status|inspect|glossary|edit|reset|translate|export PROJECT ...
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from pathlib import PurePath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fonts, providers, sinks, sources, translate
from .functions import text as X
from .operators import chunking, glossary, state, status
from .schemas import SCHEMA_VERSION
from .session import local
from .sources import pdf as pdf_source

EXPLAIN = {"empty": "no target", "tag_mismatch": "its tags differ", "too_short": "much shorter than its source", "missing_number": "a number is missing", "missing_term": "a declared term is missing", "overflow": "doesn't fit its frame"}


class Refused(Exception):
    """What a user asked for can't be done; the message says why."""


class Project:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = state.Store(spark, f"{self.path}/tables")

    def opened(self) -> Project:
        if not self.store.version():
            raise Refused(f"{self.path} has no project; run init first")
        blocks, meta = self.store.read("blocks"), self.store.read("meta")
        if state.version_of(blocks, meta) == 1:
            moved, told = state.migrate_v1(blocks, meta)
            self.store.commit(blocks=moved, meta=told)
        return self

    @property
    def blocks(self) -> DataFrame:
        return self.store.read("blocks")

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    def text(self, name: str) -> str:
        """A small text beside the tables, empty where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return ""
        return self.spark.read.text(str(path.toString()), wholetext=True).first()[0]

    def range(self, spec: str | None) -> tuple[int, int] | None:
        try:
            span = chunking.page_range(spec)
            if span:
                chunking.check_range(self.blocks, *span)
        except ValueError as e:
            raise Refused(str(e)) from None
        return span


def new_tables(blocks: DataFrame, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with ids and chunks, and the chunks, of freshly read blocks. Real pages come first, in order; then pseudo pages."""
    order = Window.partitionBy("book_id").orderBy(F.col("page_no") < 0, F.when(F.col("page_no") < 0, -F.col("page_no")).otherwise(F.col("page_no")), "pos")
    told = blocks.withColumn("block_id", F.row_number().over(order).cast("long"))
    for name, kind in (("dst_html", "string"), ("flag", "string"), ("cont_group", "int"), ("bbox", "string")):
        if name not in told.columns:
            told = told.withColumn(name, F.lit(None).cast(kind))
    told = chunking.pack(told, chunk_chars).withColumn("chunk_id", F.col("chunk_no").cast("long") + 1).drop("chunk_no")
    nothing = {c: F.lit(0).cast("long") for c in providers.USAGE}
    chunks = told.select("book_id", "chunk_id").distinct().withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))
    return told, chunks.withColumns({c: F.lit(None).cast("string") for c in ("error", "provider", "model")}).withColumns(nothing)


def init(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    project = Project(spark, a.dir or f"projects/{PurePath(a.source).stem}")
    if project.store.version() and not a.force:
        raise Refused(f"{project.path} has a project already; --force makes it anew and drops its targets")
    try:  # everything is read before anything is replaced
        blocks, chunks = new_tables(sources.load(spark, a.source), a.chunk_chars)
        blocks.persist()
        if blocks.isEmpty():
            raise Refused("no paragraph was found (only images, or protected?)")
    except sources.UnsupportedSource as e:
        raise Refused(str(e)) from None
    except (PySparkException, Py4JJavaError) as e:  # what a task found in a file
        if told := re.search(r"unsupported source .*?(?=\.? SQLSTATE|\n|$)", str(e)):
            raise Refused(told[0]) from None
        raise
    facts = {"source_name": PurePath(a.source).name, "source_path": a.source, "chunk_chars": str(a.chunk_chars), "schema_version": str(SCHEMA_VERSION)}
    meta = blocks.select("book_id").distinct().select("book_id", F.explode(F.create_map(*(F.lit(x) for pair in facts.items() for x in pair))))
    project.store.commit(blocks=blocks, chunks=chunks, meta=meta)
    blocks.unpersist()
    t = status.totals(project.blocks).first()
    return [f"{t.blocks} blocks, {t.chars:,} characters, {project.chunks.count()} chunks in {project.path}"]


def show_status(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    p = Project(spark, a.project).opened()
    t, n = status.totals(p.blocks).first(), {r.status: r.n for r in status.by_status(p.chunks).collect()}
    whole = status.complete_pages(p.blocks).agg(F.coalesce(F.sum("pages_complete"), F.lit(0))).first()[0]
    out = [f"blocks: {t.done:,} of {t.blocks:,} done; chunks: {n.get('done', 0)} done, {n.get('pending', 0)} pending, {n.get('failed', 0)} failed", f"characters left: {t.chars_left:,} of {t.chars:,}, about {t.chars_left / status.CHARS_PER_TOKEN:,.0f} tokens", f"pages done: {whole} of {t.pages}"]
    used = status.tokens(p.chunks).first()
    if used.in_tokens or used.out_tokens:
        out.append(f"used: {used.in_tokens:,} in, {used.cache_read:,} from cache, {used.cache_write:,} to cache, {used.out_tokens:,} out")
        prices = [os.environ.get(k) for k in ("PRICE_IN", "PRICE_OUT", "PRICE_CACHE_READ", "PRICE_CACHE_WRITE")]
        if prices[0] and prices[1]:
            spent = status.cost(*(None if x is None else float(x) for x in prices))
            r = status.tokens(p.chunks).select(spent.alias("spent"), status.whole_cost(spent, F.lit(t.chars), F.lit(t.chars_left)).alias("whole")).first()
            out.append(f"spent: ${r.spent:,.2f}" + (f"; the whole book about ${r.whole:,.2f}" if r.whole is not None else ""))
    out += [f"{r.provider} / {r.model}: {r.n} chunks, {r.in_tokens:,} in, {r.out_tokens:,} out" for r in status.by_model(p.chunks).collect()]
    out += [f"{r.flag}: {r.n} ({EXPLAIN.get(r.flag, 'unknown')})" for r in status.by_flag(p.blocks).collect()]
    out += [f"  block {r.block_id} ({r.place}): {r.flag}" for r in status.flag_samples(p.blocks).collect()]
    return out + [f"chunk {r.chunk_id} failed: {r.error}" for r in status.failures(p.chunks).collect()]


def inspect(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    p = Project(spark, a.project).opened()
    span = chunking.page_range(a.pages)
    blocks = p.blocks if span is None else p.blocks.where(F.col("page_no").between(*span))
    out = []
    for r in status.inspect(blocks).orderBy("book_id", "page_no", "pos").toLocalIterator():
        out += [f"--- page {r.page_header} ---"] * (r.page_header is not None)
        out.append(f"  [{r.pos:>2}] {r.kind:<8} {r.tag:<3}{f' -> group {r.cont_group}' if r.cont_group else ''} | {r.shown}")
    t = status.inspect_totals(blocks).first()
    return out + [f"{t.blocks} blocks on {t.pages} pages, {t.chars:,} characters"] if out else ["no block in this range"]


def mine(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    p = Project(spark, a.project).opened()
    found = glossary.candidates(p.blocks.where("kind <> 'skip'"), top=a.top).persist()
    n = found.count()
    if not n:
        raise Refused("no candidate (is the book very short?)")
    sinks.write_lines(glossary.candidate_lines(found), f"{p.path}/glossary.candidates")
    return [f"{n} candidates in {p.path}/glossary.candidates"]


def edit(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    p = Project(spark, a.project).opened()
    found = p.blocks.where((F.col("block_id") == a.block) & (F.lit(a.book is None) | (F.col("book_id") == a.book))).limit(2).collect()
    if not found:
        raise Refused(f"no block {a.block}")
    if len(found) > 1:
        raise Refused(f"several books have a block {a.block}; name one with --book")
    r = found[0]
    if a.set is None:
        return [f"block {r.block_id}, page {r.page_no + 1 if r.page_no >= 0 else r.page_no}, {r.kind}" + (f", {r.flag}" if r.flag else ""), f"  source: {r.src_html}", f"  target: {r.dst_html or '(none)'}"]
    try:
        p.store.commit(blocks=state.edit_block(p.blocks, r.book_id, a.block, a.set))
    except ValueError as e:
        raise Refused(str(e)) from None
    return [f"block {a.block} is changed"]


def reset(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    p = Project(spark, a.project).opened()
    span = p.range(a.pages)
    if span is None:
        raise Refused("reset needs a page range; without one it would drop every target")
    r = state.reset_preview(p.blocks, p.chunks, *span).first()
    if not r.targets:
        return ["no target in this range"]
    told = f"{r.targets} targets in {r.chunks} chunks ({r.in_tokens:,} tokens in, {r.out_tokens:,} out)"
    if not a.yes:
        return [f"would drop {told}; --yes does it"]
    blocks, chunks = state.reset_range(p.blocks, p.chunks, *span)
    p.store.commit(blocks=blocks, chunks=chunks)
    return [f"dropped {told}"]


def work(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    p = Project(spark, a.project).opened()
    span, out, todo = p.range(a.pages), [], state.pending_chunks(p.chunks)
    if span:
        touched = chunking.touching(p.blocks.where("chunk_id IS NOT NULL"), *span)
        todo, cover = state.pending_in_pages(p.chunks, touched), chunking.coverage(touched).first()
        out += [f"pages {span[0] + 1}-{span[1] + 1}: works on pages {cover.from_page + 1}-{cover.to_page + 1}"] if cover else []
    if todo.isEmpty():
        return out + ["nothing is left to do here"]
    try:
        who = providers.get(a.provider)
    except ValueError as e:
        raise Refused(str(e)) from None
    if not (a.model or who.default_model):
        raise Refused(f"{a.provider} has no model of its own; name one")
    if a.limit:
        todo = state.pending_chunks(todo, a.limit)
    declared = p.text("glossary.txt")
    lines = spark.createDataFrame(list(enumerate(declared.splitlines())), "seq int, value string")
    system = X.system_prompt(p.text("style.md"), glossary.prompt_text(lines).first()[0])
    try:
        left = translate.run(p.store, a.provider, system, glossary.parse(lines), todo, pause=a.pause, model=a.model, wave=a.wave)
    except providers.FatalError as e:
        raise Refused(f"{e}\nLook at the key, the model's name and the balance.") from None
    out += [f"chunk {r.chunk_id} failed: {r.error}" for r in status.failures(p.chunks).collect()]
    return out + [f"{left} chunks are left"]


def export(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    p = Project(spark, a.project).opened()
    source = p.store.read("meta").where("key = 'source_path'").first().value
    files = sources.binary_files(spark, source)
    fmt = sources.sniff(files).first().format

    def put(books: DataFrame, target: str) -> DataFrame:
        """Writes each book to the target, several ones to files in a folder of its name; gives the books as written."""
        books.write.mode("overwrite").parquet(f"{target}.parts")
        parts, names = spark.read.parquet(f"{target}.parts"), {}
        several = parts.limit(2).count() > 1
        for r in parts.select("book_id", "content").toLocalIterator():  # one book at a time
            stem = PurePath(r.book_id).stem
            names[stem] = names.get(stem, 0) + 1
            sinks.write_bytes(spark, f"{target}/{stem}{f'-{names[stem]}' if names[stem] > 1 else ''}.{fmt}" if several else target, r.content)
        return parts

    def epub(target: str) -> str:
        put(sinks.epub_books(files, sinks.epub_parts(p.blocks), a.bilingual), target)
        return target

    def pdf(target: str, mode: str, pages: tuple[int, int] | None, dry_run: bool, probe: bool) -> str:
        faces, sheets = fonts.choose(), pdf_source.tables(pdf_source.file_pages(files))[2]
        items = (sinks.reflow_items if mode == "reflow" else sinks.pdf_items)(p.blocks, sheets, dry_run)
        drawn = put(sinks.pdf_books(files, items, faces, mode, pages), target)
        told = drawn.select("book_id", F.explode("stats").alias("s")).select("book_id", "s.*")
        if probe:  # the report stands before the pages that it tells of
            put(sinks.pdf_books(files, items, faces, mode, pages, [r.line for r in sinks.report_lines(told).collect()]), target)
            told = spark.read.parquet(f"{target}.parts").select("book_id", F.explode("stats").alias("s")).select("book_id", "s.*")
        if not dry_run:
            p.store.commit(blocks=state.overflow_flags(p.blocks, told.where("overflow"), *(pages or (0, (1 << 31) - 1))))
        r = status.render_totals(told).first()
        return f"{target} ({r['items']} items, {r.overflows} don't fit)"

    out = []
    open_ = p.blocks.where("dst_html IS NULL").count()
    if open_:
        out.append(f"{open_} blocks have no target yet and stay as they are")
    try:
        done = sinks.write(fmt, {"epub": epub, "pdf": pdf}, a.output or f"{p.path}/{sinks.output_name(fmt, a.bilingual)}", mode=a.mode, pages=p.range(a.pages), dry_run=a.dry_run, probe=a.probe)
    except (sinks.UnsupportedTarget, fonts.MissingFont) as e:
        raise Refused(str(e)) from None
    return out + [f"written: {done}"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description="Work on books as tables")
    sub = top.add_subparsers(required=True)

    def command(name: str, f, *args: tuple, project: bool = True) -> None:
        p = sub.add_parser(name)
        if project:
            p.add_argument("project")
        for flag, options in args:
            p.add_argument(*([flag] if isinstance(flag, str) else flag), **options)
        p.set_defaults(run=f)

    yes, pages = {"action": "store_true"}, ("--pages", {})
    command("init", init, ("source", {}), ("--dir", {}), ("--chunk-chars", {"type": int, "default": chunking.DEFAULT_CHARS}), ("--force", yes), project=False)
    command("status", show_status)
    command("inspect", inspect, pages)
    command("glossary", mine, ("--top", {"type": int, "default": 200}))
    command("edit", edit, ("--block", {"type": int, "required": True}), ("--book", {}), ("--set", {}))
    command("reset", reset, pages, ("--yes", yes))
    command("translate", work, ("--provider", {"default": os.environ.get("QUIRE_PROVIDER", "echo")}), ("--model", {}), ("--limit", {"type": int}), pages, ("--pause", {"type": float, "default": 5.0}), ("--wave", {"type": int, "default": 256}))
    command("export", export, (("-o", "--output"), {}), ("--bilingual", yes), ("--mode", {"choices": sinks.PDF_MODES}), pages, ("--dry-run", yes), ("--probe", yes))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print("\n".join(args.run(spark or local(), args)))
    except Refused as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
