"""Search over lines, records and windows of lines; context and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_terms(text: Column, terms: str) -> Column:
    """All words of the query are in the text, whatever their order and case."""
    found = F.lit(True)
    for word in terms.lower().split():
        found = found & F.contains(F.lower(text), F.lit(word))
    return found


def has_tokens(text: Column, terms: str) -> Column:
    """All words of the query are whole tokens of the text (letters and digits), whatever their order and case."""
    own = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.size(F.array_except(F.array(*[F.lit(w) for w in terms.lower().split()]), own)) == 0


def has_phrase(text: Column, phrase: str) -> Column:
    return F.contains(F.lower(text), F.lit(phrase.lower()))


def search_lines(lines: DataFrame, condition: Column, *, after: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """Matching lines in (session_id, line_no) order; ``after`` resumes behind a line; a limit gives one page."""
    hits = lines.where(condition)
    if after is not None:
        session, line = after
        hits = hits.where((F.col("session_id") > session) | ((F.col("session_id") == session) & (F.col("line_no") > line)))
    return hits if limit is None else hits.orderBy("session_id", "line_no").limit(limit)


def highlights(text: Column, pattern: str) -> Column:
    """Start and end (bytes of UTF-8) of each match, in order."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.octet_length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda x: F.octet_length(x))
    steps = F.filter(F.zip_with(gaps, found, lambda gap, own: F.struct(gap.alias("gap"), own.alias("own"))), lambda s: s["own"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + s["gap"]
        span = F.struct(begin.alias("start"), (begin + s["own"]).alias("end"))
        return F.struct((begin + s["own"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(steps, start, step, lambda s: s["spans"])


def search_records(records: DataFrame, condition: Column) -> DataFrame:
    """Records whose text (lines joined by newlines) matches: session_id, record_no, kind, text."""
    return records.select("session_id", "record_no", "kind", F.array_join("lines", "\n").alias("text")).where(condition)


def search_windows(lines: DataFrame, n: int, condition: Column) -> DataFrame:
    """Windows of n lines of a session whose joined text matches, by their first line; a window that only moves on from the last is left out.

    ``condition`` is over ``text``, the window's lines.
    """
    by_session = Window.partitionBy("session_id").orderBy("line_no")
    following = by_session.rowsBetween(0, n - 1)
    windows = lines.select("device", "session_id", "line_no", F.array_join(F.collect_list("text").over(following), "\n").alias("text"))
    hits = windows.withColumn("hit", condition).withColumn("last", F.lag("hit").over(by_session))
    return hits.where("hit and not coalesce(last, false)").select("device", "session_id", "line_no")


def context(lines: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """The lines around each anchor (session_id, line_no): anchor_line, line_no, distance, text.

    Anchors are spread over the line numbers they ask for, and met by an equi-join.
    """
    asked = anchors.select("session_id", F.col("line_no").alias("anchor_line"), F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("line_no"))
    met = lines.join(asked, ["session_id", "line_no"])
    return met.select("session_id", "anchor_line", "line_no", (F.col("line_no") - F.col("anchor_line")).alias("distance"), "text")


def recent(lines: DataFrame, n: int, *, include_blank: bool = False, mute: Column | None = None) -> DataFrame:
    """The last n lines of every device in (session_id, line_no) order, without blank and muted ones."""
    kept = lines
    if not include_blank:
        kept = kept.where(F.trim("text") != "")
    if mute is not None:
        kept = kept.where(~mute)
    newest = Window.partitionBy("device").orderBy(F.desc("session_id"), F.desc("line_no"))
    ranked = kept.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)
    return ranked.select("device", "session_id", "line_no", "text")


def across_devices(hits: DataFrame, limit: int) -> DataFrame:
    """Hits of all devices in turn: the first of each, then the second of each."""
    own = Window.partitionBy("device").orderBy("session_id", "line_no")
    dealt = hits.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= limit)
    return dealt.orderBy("turn", "device").limit(limit).select("turn", "device", "session_id", "line_no")


def postings(lines: DataFrame) -> DataFrame:
    """The token index: token, device, session_id, line_no, once a line."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return lines.select("device", "session_id", "line_no", F.explode(words).alias("token"))


def indexed_terms(index: DataFrame, terms: str) -> DataFrame:
    """Lines with all terms, from the index: one pass over the terms' postings."""
    wanted = sorted(set(terms.lower().split()))
    met = index.where(F.col("token").isin(wanted)).groupBy("device", "session_id", "line_no").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") == len(wanted)).drop("n")


def lines_of_records(records: DataFrame, lines: DataFrame) -> DataFrame:
    """record_id with the text of its lines first_line..last_line, joined in order.

    The interval is spread into line numbers for an equi-join on them.
    """
    spread = records.select("record_id", "session_id", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    met = spread.join(lines, ["session_id", "line_no"]).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("own"))
    return met.select("record_id", F.size("own").cast("long").alias("n_lines"), F.array_join("own.text", "\n").alias("text"))
