"""Language identification by compression.

One zstandard raw-content dictionary per language, made of labelled sample texts;
a text is compressed with each and goes to the language whose dictionary makes
it smallest. The dictionaries are fitted on a bounded sample: per language the
``SAMPLE_DOCS`` labelled training rows with the smallest hash of their id, of each
as many characters as share ``DICTIONARY_BYTES`` equally among the rows that the
language has, from a place in the text that the hash chooses. Every language that a
training row has is learned. Everything else covers all rows and whole texts.

Compared is what tells languages apart: lower-cased letters, everything else as
one blank. Texts are compressed in equal pieces of at most ``PIECE_BYTES``, each
with the fresh dictionaries, and the sizes of all pieces are added up: what a
dictionary saves would else be lost against the size of a long text, which
zstandard learns from the text itself. Where sizes tie, the language with more
training rows comes first. The margin is the relative difference to the second smallest
size; ``score`` rises with it, from 0 at a tie to 1.

A row is rejected when it has no letter, when the two smallest sizes tie, or when its
dictionary does less for it than dictionaries do for texts of their language. Two shares
say what it does: what it saves of the size without any dictionary, and how much of that
the second best dictionary doesn't save. Both depend on length, so their limits are fitted by
length, for each power of two of the bytes in a piece: ``SLACK`` times the ``QUANTILE`` of the shares
that up to ``LIMIT_DOCS`` more rows of a language show, cut to that length. A power of two that
the fitted rows don't reach has the limits of the nearest one.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; without any labelled training row every text is ``und``; repeated
rows get equal results; an empty table gives an empty result. Language, source
and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import stage_table, text_or_empty

UNKNOWN = "und"
#: Bounds of the fitted sample: rows and bytes of a language.
SAMPLE_DOCS = 200
DICTIONARY_BYTES = 256 << 10
#: Parts of a language that first choose their rows on their own, so that no task sees more than so many times SAMPLE_DOCS.
PARTS = 64
LEVEL = 5
PIECE_BYTES = 32 << 10
#: Rows of a language that limits are fitted on, their characters, and what of their shares is the limit.
LIMIT_DOCS, LIMIT_CHARS, QUANTILE, SLACK = 60, 32 << 10, 0.02, 0.5
#: Fewer cuts of one length fit no limit.
LEAST_CUTS = 20

LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def only_letters(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "ignore")


def _sample(docs: DataFrame, train: Column, sample_docs: int, dictionary_bytes: int) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Per language the texts of its dictionary, and those that limits are fitted on; languages with more training rows come first."""
    labelled = docs.filter(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce("text", F.lit("")) != ""))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = labelled.select("doc_id", "lang", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= sample_docs + LIMIT_DOCS)
    ids = stage_table(ids.select("doc_id", "lang", "place"), "language-sample")
    rows_of = {r["lang"]: r["count"] for r in ids.filter(F.col("place") <= sample_docs).groupBy("lang").count().collect()}
    texts: dict[str, list[tuple[int, str]]] = {row["lang"]: [] for row in counts}
    more: dict[str, list[tuple[int, str]]] = {row["lang"]: [] for row in counts}
    if not texts:
        return {}, {}
    share = F.create_map(*[x for lang, n in rows_of.items() for x in (F.lit(lang), F.lit(max(1, dictionary_bytes // n)))])
    size = F.when(F.col("place") <= sample_docs, F.element_at(share, F.col("lang"))).otherwise(LIMIT_CHARS)
    # a place in the text, and so much from there
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - size, F.lit(0)) + 1).cast("int") + 1
    # ids holds at most sample_docs + LIMIT_DOCS rows a language: small by construction, so it may be broadcast
    sample = labelled.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("lang", "place", F.substring("text", start, size).alias("text"))
    for row in sample.collect():
        (texts if row.place <= sample_docs else more)[row.lang].append((row.place, row.text))
    return tuple({lang: [t for _, t in sorted(rows)] for lang, rows in found.items()} for found in (texts, more))


def _dictionaries(texts: dict[str, list[str]], dictionary_bytes: int) -> dict[str, bytes]:
    return {lang: only_letters(" ".join(own))[:dictionary_bytes] for lang, own in texts.items()}


def fit(docs: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionary per language, from a bounded sample of the rows where ``train`` holds."""
    return _dictionaries(_sample(docs, train, sample_docs, dictionary_bytes)[0], dictionary_bytes)


#: By power of two of a piece's bytes: least saved share, least share of the savings that the second best lacks.
Limits = dict[int, tuple[float, float]]


def fit_judge(docs: DataFrame, train: Column) -> tuple[dict[str, bytes], Limits]:
    """Dictionaries, and the limits that texts of their languages keep."""
    texts, more = _sample(docs, train, SAMPLE_DOCS, DICTIONARY_BYTES)
    dictionaries = _dictionaries(texts, DICTIONARY_BYTES)
    return dictionaries, limits(dictionaries, more)


def limits(dictionaries: dict[str, bytes], texts: dict[str, list[str]]) -> Limits:
    if len(dictionaries) < 2:
        return {}
    judge = Judge(dictionaries)
    shares: dict[int, list[tuple[float, float]]] = {}
    for lang, own in texts.items():
        for body in map(only_letters, own):
            for power in range(3, PIECE_BYTES.bit_length()):
                if len(body) < 1 << power:
                    break
                cut = body[(len(body) - (1 << power)) // 2 :][: 1 << power]
                best, *found = judge.shares(cut)
                if best == lang:
                    shares.setdefault(power, []).append(tuple(found))
    low = lambda values: SLACK * sorted(values)[int(len(values) * QUANTILE)]
    return {power: (low([s for s, _ in found]), low([g for _, g in found])) for power, found in shares.items() if len(found) >= LEAST_CUTS}


class Judge:
    """Sizes of a text behind every language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], limits: Limits | None = None):
        self.limits = limits or {}
        self.langs = list(dictionaries)
        # one set of parameters for all, made for the largest dictionary, so that sizes differ by content only
        most = max(map(len, dictionaries.values()), default=0)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=most, write_content_size=0, write_dict_id=0)
        self.packers = [self._packer(d, how) for d in dictionaries.values()]
        self.plain = zstandard.ZstdCompressor(compression_params=how)

    @staticmethod
    def _packer(content: bytes, how: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def __call__(self, text: str) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the row is rejected."""
        if not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        lang, margin, saved, gap, piece = self.judged(only_letters(text))
        if len(self.langs) == 1:
            return lang, 1.0, 1.0, False
        power = piece.bit_length() - 1
        least = self.limits[min(self.limits, key=lambda p: abs(p - power))] if self.limits else (0.0, 0.0)
        return lang, min(1.0, 4 * margin), margin, margin <= 0 or saved < least[0] or gap < least[1]

    def judged(self, body: bytes) -> tuple[str, float, float, float, int]:
        """Language, margin, saved share, share of the savings that the second best lacks, and bytes of a piece."""
        count = -(-len(body) // PIECE_BYTES)
        parts = [body[len(body) * k // count : len(body) * (k + 1) // count] for k in range(count)]
        sizes = [sum(len(p.compress(part)) for part in parts) for p in self.packers]
        best = min(sizes)
        lang = self.langs[sizes.index(best)]
        if len(sizes) == 1:
            return lang, 1.0, 1.0, 1.0, len(parts[0])
        second, plain = sorted(sizes)[1], sum(len(self.plain.compress(part)) for part in parts)
        saved = max(0, plain - best)
        return lang, (second - best) / second, saved / plain, min(1.0, (second - best) / max(1, saved)), len(parts[0])

    def shares(self, body: bytes) -> tuple[str, float, float]:
        lang, _, saved, gap, _ = self.judged(body)
        return lang, saved, gap


def classify(docs: DataFrame, dictionaries: dict[str, bytes], limits: Limits | None = None) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, limits)
        for b in batches:
            langs, scores, margins, rejected = [], [], [], []
            for text in b.column(1):
                lang, score, margin, narrow = judge(text.as_py())
                langs.append(lang)
                scores.append(score)
                margins.append(margin)
                rejected.append(narrow)
            yield pa.record_batch(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_accepted(docs: DataFrame, dictionaries: dict[str, bytes], limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not rejected; narrow, nothing is joined."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, limits)
        for b in batches:
            kept = [not judge(text.as_py() or "")[3] for text in b.column(at)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a recognised language, learned from the training folds of ``docs`` itself."""
    rows = docs.select("doc_id", "text", "lang")
    return keep_accepted(docs, *fit_judge(rows, ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from all folds but one, predicted for every document."""
    rows = docs.select("doc_id", "text", "lang")
    found = classify(rows, *fit_judge(rows, ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
