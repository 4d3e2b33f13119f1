"""A stored index of words, and searches that read the part of it that they need.

Below the index's folder ``postings`` has a row a word of a line: token (lower-cased run of letters and digits), part and line of the session, and the
positions of the word among the line's words. ``lines`` has the lines themselves. Both are parted by batch, postings by a bucket of the token,
lines by a part of the sessions. A batch is added without reading what is there, and one that is added again replaces itself. ``tokens`` lists each batch's
distinct tokens; it grows with the vocabulary, not with the log.

A search asks for tokens: whole ones are looked up in their buckets (partition pruning) and, within the sorted files, by value (row groups). Pieces of tokens, as a
pattern may ask for, are looked up among the listed tokens first. The lines that hold all of them are candidates, and the condition is tested on these lines. A pattern
that asks for nothing in particular is tested on all lines. Results are those of a scan.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import release_driver

BUCKETS, PARTS = 64, 64
_WORD = re.compile(r"[0-9a-z]+")
_SPLIT = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Piece:
    """A run of letters and digits that a line must hold; an open end may go on within its token."""

    text: str
    open_left: bool = False
    open_right: bool = False

    @property
    def whole(self) -> bool:
        return not (self.open_left or self.open_right)


#: What a line must hold: of each group at least one alternative, of an alternative every piece.
Required = list[list[list[Piece]]]


def pieces_of(literal: str, open_left: bool = True, open_right: bool = True) -> list[Piece]:
    """The runs of ASCII letters and digits in a text that stands somewhere in a line.

    A run next to a character beyond ASCII may belong to a longer token, as may one at an open end.
    """
    lower = literal.lower()
    out = []
    for m in _WORD.finditer(lower):
        lo, hi = m.span()
        left = lower[lo - 1] > "\x7f" if lo else open_left
        right = lower[hi] > "\x7f" if hi < len(lower) else open_right
        out.append(Piece(m[0], left, right))
    return out


def required(pattern: str) -> Required:
    """What every match of a pattern holds, as far as the standard library's own parser sees it; nothing for a pattern that it can't read."""
    from re import _constants as c
    from re import _parser

    try:
        tree = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return []

    def literal(node: tuple) -> str | None:
        op, arg = node
        return chr(arg) if op is c.LITERAL and arg < 128 else None

    def walk(nodes) -> Required:
        out: Required = []
        run = ""

        def end() -> None:
            nonlocal run
            if found := pieces_of(run):
                out.append([found])
            run = ""

        for node in nodes:
            op, arg = node
            if (char := literal(node)) is not None:
                run += char
                continue
            end()
            if op is c.SUBPATTERN:
                out.extend(walk(arg[3]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] >= 1:
                out.extend(walk(arg[2]))
            elif op is c.ATOMIC_GROUP:
                out.extend(walk(arg))
            elif op is c.BRANCH:
                choices = [walk(branch) for branch in arg[1]]
                if all(choices):  # each alternative with the group that says most: its longest piece
                    best = [max((g for g in choice if len(g) == 1), key=lambda g: max(len(p.text) for p in g[0]), default=None) for choice in choices]
                    if all(best):
                        out.append([g[0] for g in best])
        end()
        return out

    return walk(tree)


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def postings_of(kept: DataFrame) -> DataFrame:
    """Postings of lines (device, session_id, line_no, text, part), dealt by bucket."""
    words = F.filter(F.split(F.lower("text"), _SPLIT), lambda w: w != "")
    word = kept.select("device", "session_id", "line_no", "part", F.posexplode(words).alias("place", "token"))
    # A bucket's rows are spread over tasks by line, as a frequent word may have any share of them. Places are collected within a line, so nothing large meets in
    # one group; bucket and spread are among the keys, so that words are sent once.
    keys = ["bucket", "spread", "token", "part", "device", "session_id", "line_no"]
    bucketed = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int")
    word = word.withColumns({"bucket": bucketed, "spread": F.pmod(F.xxhash64("session_id", "line_no"), F.lit(4))}).repartition("bucket", "spread")
    return word.groupBy(*keys).agg(F.array_sort(F.collect_list("place")).alias("places")).select("token", "part", "device", "session_id", "line_no", "places", "bucket")


class Index:
    """The index below a folder; devices and sessions have types of their own."""

    def __init__(self, spark: SparkSession, folder: str, device: str = "string", session: str = "long"):
        self.spark, self.folder = spark, folder.rstrip("/")
        keys = f"device {device}, session_id {session}, line_no long"
        self.schemas = {
            "postings": f"token string, part int, {keys}, places array<int>, batch string, bucket int",
            "lines": f"{keys}, text string, batch string, part int",
            "tokens": "token string, bucket int, lines long, batch string",
        }

    def append(self, lines: DataFrame, batch: str) -> None:
        """Adds a batch of lines (device, session_id, line_no, text)."""
        part = F.pmod(F.xxhash64("session_id"), F.lit(PARTS)).cast("int")
        kept = lines.select("device", "session_id", F.col("line_no").cast("long").alias("line_no"), "text", part.alias("part"))

        def write(df: DataFrame, table: str, *by: str) -> None:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{table}/batch={batch}")

        # Sorted for row groups to tell tokens apart.
        write(postings_of(kept).sortWithinPartitions("bucket", "token", "session_id", "line_no"), "postings", "bucket")
        release_driver(self.spark)  # the words' shuffle files
        write(kept.repartition("part").sortWithinPartitions("part", "session_id", "line_no"), "lines", "part")
        release_driver(self.spark)
        own = self.table("postings").where(F.col("batch") == batch)
        write(own.groupBy("token", "bucket").agg(F.count(F.lit(1)).alias("lines")), "tokens")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def holders(self, alternatives: list[list[Piece]]) -> DataFrame:
        """device, session_id, line_no, part of the lines that hold all pieces of one alternative at least, each once."""
        found = []
        for pieces in alternatives:
            wanted = max(pieces, key=lambda p: (p.whole, len(p.text)))  # the one that is the most special tells the candidates
            found.append(self._of(wanted))
        return reduce(DataFrame.unionByName, found).distinct()

    def _of(self, piece: Piece) -> DataFrame:
        postings = self.table("postings")
        keys = ["device", "session_id", "line_no", "part"]
        if piece.whole:
            return postings.where((F.col("bucket") == bucket(piece.text)) & (F.col("token") == piece.text)).select(*keys)
        token, text = F.col("token"), F.lit(piece.text)
        fits = F.contains(token, text) if piece.open_left and piece.open_right else F.endswith(token, text) if piece.open_left else F.startswith(token, text)
        listed = self.table("tokens").where(fits).select("token", "bucket").distinct()
        return postings.join(listed, ["token", "bucket"]).select(*keys).distinct()

    def candidates(self, wanted: Required) -> DataFrame | None:
        """Lines that hold what is required; none if nothing is."""
        groups = [self.holders(g) for g in wanted if all(g)]
        return reduce(lambda a, b: a.join(b, ["device", "session_id", "line_no", "part"], "left_semi"), groups) if groups else None

    def search(self, wanted: Required, condition: Column) -> DataFrame:
        """device, session_id, line_no, text of the lines for which the condition on ``text`` holds."""
        lines, known = self.table("lines"), self.candidates(wanted)
        if known is not None:
            lines = lines.join(known, ["part", "device", "session_id", "line_no"], "left_semi")
        return lines.where(condition).select("device", "session_id", "line_no", "text")

    def regex(self, pattern: str) -> DataFrame:
        return self.search(required(pattern), F.col("text").rlike(pattern))

    def phrase(self, phrase: str) -> DataFrame:
        """Lines that hold a phrase, in any case."""
        return self.search([[[p]] for p in pieces_of(phrase)], F.contains(F.lower("text"), F.lit(phrase.lower())))

    def words(self, phrase: str) -> DataFrame:
        """device, session_id, line_no of the lines in which whole words stand side by side, from their places alone."""
        wanted = [w for w in re.split(r"[\W_]+", phrase.lower()) if w]

        def begins(k: int, w: str) -> DataFrame:
            """Where the phrase would begin, of each line that holds its word number k."""
            own = self.table("postings").where((F.col("bucket") == bucket(w)) & (F.col("token") == w))
            return own.select("device", "session_id", "line_no", F.transform("places", lambda p: p - k).alias(f"p{k}"))

        placed = [begins(k, w) for k, w in enumerate(wanted)]
        met = reduce(lambda a, b: a.join(b, ["device", "session_id", "line_no"]), placed)
        together = reduce(F.array_intersect, [F.col(f"p{k}") for k in range(len(wanted))])
        return met.where(F.size(together) > 0).select("device", "session_id", "line_no")
