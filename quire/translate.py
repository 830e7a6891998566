"""The resumable work loop: prompts for what is open, answers, checks, and new snapshots after each attempt."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import providers
from .functions import text as X
from .operators import context, quality, state


def prompts(blocks: DataFrame, open_blocks: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(book_id, chunk_id, prompt): context, then the open segments in order; on a retry, what was wrong with them."""
    before = context.context_text(context.chunk_context(blocks))
    seg = F.struct("block_id", X.segment(F.col("block_id"), F.col("src_html")).alias("s"))
    parts = open_blocks.groupBy("book_id", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(seg)), lambda x: x["s"]), "\n").alias("segments"))
    joined = parts.join(before, ["book_id", "chunk_id"], "left")
    if notes is None:
        return joined.select("book_id", "chunk_id", X.user_prompt(F.col("context"), F.col("segments")).alias("prompt"))
    told = joined.join(notes, ["book_id", "chunk_id"], "left")
    return told.select("book_id", "chunk_id", X.user_prompt(F.col("context"), F.col("segments"), F.col("note")).alias("prompt"))


def checked(answers: DataFrame, open_blocks: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Open blocks with the answer's segment of their id, its flag and the action; unknown ids are passed over."""
    found = answers.where("answer IS NOT NULL").select("book_id", "chunk_id", "attempt", F.explode(X.segments(F.col("answer"))).alias("s"))
    pairs = open_blocks.join(found.select("book_id", "chunk_id", "attempt", F.col("s.id").alias("block_id"), F.trim("s.body").alias("dst")), ["book_id", "chunk_id", "block_id"])
    pairs = pairs.select("book_id", "chunk_id", "block_id", "attempt", F.col("src_html").alias("src"), "dst").withColumn("id", F.concat_ws(":", "attempt", "book_id", "block_id"))
    return quality.check(pairs, glossary).drop("id")


def run(store: state.Store, provider: str | Callable, system: str = "", glossary: DataFrame | None = None, chunks: DataFrame | None = None, attempts: int = state.ATTEMPTS, pause: float = 5.0, model: str | None = None, wave: int = 256) -> int:
    """Works on all pending chunks (or the pending ones among ``chunks``), in order, ``wave`` chunks at a time.

    A wave ends with one snapshot of its blocks and chunks together, so a run that is stopped loses one wave at most (a chunk, with
    ``wave=1``). After a fatal error, what others of its wave have finished is kept, the chunk stays as it was, and nothing more is
    called. Returns how many chunks are left.
    """
    after: tuple[str, int] | None = None
    while True:
        ledger = store.read("chunks")
        work = ledger if chunks is None else ledger.join(chunks.select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_semi")
        if after:
            work = work.where((F.col("book_id") > after[0]) | ((F.col("book_id") == after[0]) & (F.col("chunk_id") > after[1])))
        rows = [(r.book_id, r.chunk_id) for r in state.pending_chunks(work, wave).select("book_id", "chunk_id").collect()]  # wave rows at most
        if not rows:
            return state.pending_chunks(store.read("chunks")).count()
        stop = _wave(store, ledger.join(store.spark.createDataFrame(rows, "book_id string, chunk_id long"), ["book_id", "chunk_id"], "left_semi"), provider, system, glossary, attempts, pause, model)
        if stop is not None:
            raise providers.FatalError(stop)
        after = max(rows)


def _wave(store: state.Store, part: DataFrame, provider: str | Callable, system: str, glossary: DataFrame | None, attempts: int, pause: float, model: str | None) -> str | None:
    """Up to ``attempts`` rounds for the chunks of ``part``, each only for blocks still open; then their snapshot. What a fatal error says, or None."""
    blocks, ledger = store.read("blocks"), store.read("chunks")
    first = state.pending_blocks(blocks, part)
    todo, found, stop, attempt = first, None, None, 0
    while stop is None and attempt < attempts and not todo.isEmpty():
        if attempt:
            time.sleep(min(30.0, pause * attempt))
        attempt += 1
        note = None if attempt == 1 else todo.select("book_id", "chunk_id").distinct().withColumn("note", F.lit("Some segments were missing or wrong. Answer every segment, with its tags and numbers."))
        new = providers.ask(prompts(blocks, todo, note), provider, system, model).withColumn("attempt", F.lit(attempt))
        store.commit(answers=new if found is None else found.unionByName(new))  # kept before anything is made of it
        found = store.read("answers")
        pairs = checked(found.where("called AND NOT fatal"), first, glossary)
        todo = first.join(state.settle(pairs, False), ["book_id", "chunk_id", "block_id"], "left_anti")
        error = found.where("fatal").select("error").first()
        stop = None if error is None else error[0]
    if found is None:
        return None
    broken = found.where("fatal OR NOT called").select("book_id", "chunk_id").distinct()
    tried = found.join(broken, ["book_id", "chunk_id"], "left_anti")
    taken = state.settle(checked(tried, first, glossary), True)
    done = state.update_blocks(blocks, taken.select("book_id", "block_id", F.col("dst").alias("dst_html"), "flag"))
    store.commit(blocks=done, chunks=state.finalise(ledger, done, tried))
    return stop
