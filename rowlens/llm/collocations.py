"""Phrase collocations from bounded generalised suffix automata, one a shard, reduced globally.

A shard is a few megabytes of text of one language in one task. Its automaton holds
every substring of at most so many words: a state of depth k is the set of ends of one
k-word substring (``endpos``; its size is the count), and its suffix link leads to
the state of the same ends without the first word. The states are built one depth at
a time by sorting (link, word put in front), which gives those of the online
construction without its per-word loop. Pieces and documents of a shard are kept apart
by a break, so no substring passes one.

Counts of a shard mean nothing alone, so they are summed over all shards by phrase,
depth by depth. A phrase can be frequent only if its link and its prefix are; the next
depth therefore leaves out states whose link or prefix is not marked in a bitmap of the
frequent phrases of the depth before. The bitmap has a fixed size (``BITS``, 8 MB), is
made by Spark and sent to the tasks; a wrong hit costs a row that the global count
drops, so the result doesn't depend on it. Subsumption walks the links of the longer
candidates and those of the reversed text (the phrase without its last word).

Scores are floors of exact decimal quotients.

Defined results: null text counts as empty, a null language as ``und``; documents are
not told apart, so repeated rows and ids count as often as they stand there; an empty
table gives an empty result. Texts of any length are cut between pieces only. Only text
and language are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import drop_stage, stage_table, text_or_empty

UNKNOWN = "und"
MAX_WORDS, MIN_COUNT, SUBSUMED, TOP = 3, 10, 50, 2000
#: Bytes of text of a shard, and rows that go back to Spark at once.
SHARD_BYTES, ROWS = 4 << 20, 1 << 15
#: A prime: bits of the bitmap of frequent phrases; and the base of the phrase hash.
BITS, BASE = 67_108_859, 1_000_003
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: No byte of UTF-8 text.
BREAK = b"\xff"
FOLD = bytes.maketrans(bytes(range(65, 91)) + BREAKS, bytes(range(97, 123)) + BREAK * len(BREAKS))


class Automaton:
    """States of all substrings of one shard, up to the depth that ``deepen`` has reached.

    ``state[i]`` is the state of the substring that ends at word i, or -1; ``ends``
    and ``last`` give the size of endpos and one end of each state.
    """

    def __init__(self, text: bytes, lang: str):
        tokens = pa.array(text.translate(FOLD).replace(BREAK, b" \xff ").split(), pa.binary()).dictionary_encode()
        words = tokens.dictionary.to_pylist()
        self.word = tokens.indices.to_numpy().astype(np.int64)
        self.names = words
        inside = np.array([w != BREAK for w in words], dtype=bool)
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
        self.start = zlib.crc32(lang.encode()) % BITS
        self.depth = 1
        self.state = np.where(inside[self.word], self.word, -1) if len(words) else self.word
        self.ends = np.bincount(self.word, minlength=len(words))
        self.last = np.zeros(len(words), dtype=np.int64)
        self.last[self.word] = np.arange(len(self.word))
        self.real = inside
        self.total = int((self.state >= 0).sum())

    def hashes(self) -> np.ndarray:
        """Phrase hash of every state, as ``phrase_hash`` has it."""
        value = np.full(len(self.last), self.start, dtype=np.int64)
        for back in range(self.depth - 1, -1, -1):
            value = (value * BASE + self.crc[self.word[self.last - back]]) % BITS
        return value

    def deepen(self, marked: np.ndarray) -> None:
        """One word more in front; only below links and behind prefixes that the bitmap holds."""
        at = self.hashes()
        passing = (marked[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & self.real
        good = np.zeros(len(self.state), dtype=bool)
        held = self.state >= 0
        good[held] = passing[self.state[held]]
        end = np.flatnonzero(good[1:] & good[:-1]) + 1
        front = self.word[end - self.depth]
        key = self.state[end] * max(1, len(self.names)) + front
        _, first, state, ends = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.state = np.full(len(self.word), -1, dtype=np.int64)
        self.state[end] = state
        self.last, self.ends = end[first], ends
        self.real = np.ones(len(first), dtype=bool)
        self.depth += 1

    def phrases(self) -> tuple[pa.Array, np.ndarray]:
        """Every substring of the present depth, and how often it ends somewhere."""
        last, ends = self.last[self.real], self.ends[self.real]
        names = pa.array(self.names, pa.binary())
        parts = [names.take(pa.array(self.word[last - back])) for back in range(self.depth - 1, -1, -1)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if len(parts) > 1 else parts[0]
        return joined.cast(pa.string()), ends


def _slices(text: bytes) -> Iterator[bytes]:
    """A shard's text; a longer one is cut where a piece ends."""
    at = 0
    while at < len(text):
        cut = min((p for p in (text.find(bytes([b]), at + SHARD_BYTES) for b in BREAKS) if p >= 0), default=len(text)) if len(text) - at > SHARD_BYTES else len(text)
        yield text[at:cut]
        at = cut


def _shard_counts(docs: DataFrame, depth: int, bitmaps: list[bytes]) -> DataFrame:
    """lang, phrase and count of every shard's substrings of ``depth`` words; a null phrase counts all words."""

    def flush(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        marks = [np.frombuffer(b, dtype=np.uint8) for b in bitmaps]
        for lang, texts in held.items():
            for part in _slices(b"\n".join(texts)):
                shard = Automaton(part, lang)
                for marked in marks:
                    shard.deepen(marked)
                phrase, n = shard.phrases()
                if depth == 1:
                    phrase, n = pa.concat_arrays([phrase, pa.array([None], pa.string())]), np.append(n, shard.total)
                del shard
                for at in range(0, len(n), ROWS):
                    some = phrase.slice(at, ROWS)
                    yield pa.record_batch([pa.repeat(pa.scalar(lang), len(some)), some, pa.array(n[at : at + ROWS], pa.int64())], names=["lang", "phrase", "n"])
                del phrase, n
                pa.default_memory_pool().release_unused()
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held.setdefault(lang, []).append(text.as_py())
                size += len(held[lang][-1])
                if size >= SHARD_BYTES:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def phrase_hash(lang: Column, words: Column) -> Column:
    """Place of a phrase in the bitmap; no step passes 2**47."""
    step = lambda h, w: F.pmod(h * BASE + F.crc32(w.cast("binary")), F.lit(BITS))
    return F.aggregate(words, F.pmod(F.crc32(lang.cast("binary")), F.lit(BITS)), step)


def _bitmap(phrases: DataFrame) -> bytes:
    """The fixed-size bitmap of a table of phrases; at most BITS / 32 rows come to the driver."""
    at = phrase_hash(F.col("lang"), F.split("phrase", " "))
    cells = phrases.select(at.alias("at")).groupBy(F.expr("at div 32").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))
    found = cells.toArrow()
    marked = np.zeros(BITS // 32 + 1, dtype="<u4")
    marked[found["cell"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return marked.tobytes()


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, words, f of all phrases of 1 to ``max_words`` words with f >= ``min_count``, and one row a language with null phrase and its word count."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty("text").alias("text"))
    levels: list[DataFrame] = []
    bitmaps: list[bytes] = []
    for depth in range(1, max_words + 1):
        counts = _shard_counts(rows, depth, bitmaps).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        kept = counts.filter(F.col("phrase").isNull() | (F.col("f") >= min_count)).withColumn("words", F.lit(depth))
        levels.append(stage_table(kept, f"phrases-{depth}"))
        if depth < max_words:
            bitmaps.append(_bitmap(levels[-1].filter("phrase is not null")))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    every = stage_table(found, "phrases")
    for level in levels:
        drop_stage(level)
    return every


def _score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (l * r)) in decimals; counts stay below 10**15."""
    d = "cast({} as decimal(15, 0))".format
    return f"cast(floor(1000000) as decimal(7, 0)) * ({d(a)} * {d(a)}) div ({d(left)} * {d(right)})"


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top`` phrases."""
    every = frequent_phrases(docs, max_words, min_count)
    phrases = every.filter("phrase is not null")
    totals = every.filter("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = phrases.filter("words > 1").select("lang", "phrase", "words", F.split("phrase", " ").alias("parts"), F.col("f").alias("a"))

    # the link of a longer candidate, and its link in the reversed text
    links = F.array(F.expr("array_join(slice(parts, 2, words - 1), ' ')"), F.expr("array_join(slice(parts, 1, words - 1), ' ')"))
    longer = candidates.filter("words > 2").select("lang", F.explode(links).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(f"longest is null or 100 * longest < {subsumed} * a")

    cut = kept.select("lang", "phrase", "a", "parts", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.withColumn("first", F.expr("array_join(slice(parts, 1, k), ' ')")).withColumn("rest", F.expr("array_join(slice(parts, k + 1, words), ' ')"))
    lefts = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rights = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"]).withColumn("score", F.expr(_score("a", "l", "r")).cast("long"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # a row for each of at most ``top`` phrases a language
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with texts as (
    select row_number() over () as doc, coalesce(lang, 'und') as lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
), pieces as (
    select doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts
), numbered as (
    select row_number() over () as piece_id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces
), grams as (
    select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase
    from numbered, (values (1), (2), (3)) t(k), unnest(range(1, len(words) - k + 2)) u(i)
), counts as (
    select lang, k, phrase, count(*) as f from grams group by all
), totals as (
    select lang, sum(f)::bigint as n from counts where k = 1 group by lang
), candidates as (
    select lang, k, phrase, f as a, string_split(phrase, ' ') as parts from counts where k > 1 and f >= 10
), longer as (
    select lang, phrase, max(a) as longest from (
        select lang, array_to_string(parts[2:], ' ') as phrase, a from candidates where k = 3
        union all
        select lang, array_to_string(parts[:2], ' ') as phrase, a from candidates where k = 3
    ) group by all
), kept as (
    select c.* from candidates c left join longer g on c.lang = g.lang and c.phrase = g.phrase
    where longest is null or 100 * longest < 50 * a
), cuts as (
    select x.lang, x.phrase, x.a, cut, p.f as l, q.f as r,
           ((1000000::hugeint * x.a * x.a) // (p.f::hugeint * q.f))::bigint as score
    from (select kept.*, unnest(range(1, k)) as cut from kept) x
    join counts p on p.lang = x.lang and p.phrase = array_to_string(x.parts[:x.cut], ' ')
    join counts q on q.lang = x.lang and q.phrase = array_to_string(x.parts[x.cut + 1:], ' ')
), best as (
    select lang, phrase, a, l, r, score from cuts
    qualify row_number() over (partition by lang, phrase order by score, cut) = 1
)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best b join totals t on t.lang = b.lang
qualify row_number() over (partition by b.lang order by score desc, a desc, phrase) <= 2000
"""
