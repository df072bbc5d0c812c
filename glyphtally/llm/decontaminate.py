"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, units after numbers, and names (capitalised words that do
not open a sentence, runs of them as one) are replaced by typed placeholders whose values are kept
as slots; other words are lower-cased and lose their punctuation. Windows of WINDOW template tokens of the benchmark and of
the documents are hash-joined. On each diagonal (a document, an item, an offset) the slots must be
consistent: one value of the item always stands for the same value of the document. A document is contaminated by an
item if consistent diagonals cover at least COVER of the item's windows: `verbatim` if no slot
changed, else `reparameterised`.

Case decides what is a name, so copies in another letter case have other templates. Each text is therefore
read a second time with names as words, letter case folded (in any script) and only numbers and units typed; windows
of this reading are joined among themselves. A pair is reported for the reading that covers more of the item.
Windows of fewer than LITERAL words would match anything with changed slots: the first reading leaves them out, the second
joins them by their very words. So it holds all windows, and a run of RUN words of an item, word for word, is a
contamination (`verbatim`) however small a part of the item it is.

A bitmap of the benchmark's window hashes, of fixed size, picks the document windows that are
joined at all, so the corpus is not shuffled; the join itself is Spark's and holds for any benchmark.

Nulls, empty texts and texts below ``least`` words hold and leak nothing. Items of ``least`` to WINDOW-1
words are one window of their own length. Equal items each get their rows. Repeated documents give repeated
matches counted once per id; documents without id go by the hash of their text, so equal ones share a row. Items without id leak nothing. An empty
table, of documents or items, gives no rows. Very long texts are read whole. Ties between the readings go to the one without changes, then
to the one with names. Only ids and texts are looked at, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BYTE, _SPACE, Scratch, bounded_batches, chunks, mix64, tidy, without_ids

WINDOW = 8
#: Words of an item, at least: shorter ones are phrases of any text. With 1, all items are looked for.
LEAST = 5
COVER = 0.5
#: Running words of an item, word for word, that contaminate a document at any coverage.
RUN = 13
#: Words of a window that must be words, not placeholders, if slots may change.
LITERAL = 4
BITS = 24
#: Keeps the windows of the two readings apart.
_FOLDED, _EXACT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Letters whose case is folded before hashing; a table does it for the others.
_OTHER_CASE = re.compile("[\u00b5\u00df\u0100-\U0010ffff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.random.default_rng(99).integers(1, 1 << 63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NUMBER, NAME, UNIT = (np.uint64(k) for k in (0xA1B2C3D4E5F60718, 0x1F2E3D4C5B6A7988, 0x0123456789ABCDEF))
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles g kg mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules "
    "meter meters metre metres kilometer kilometers kilometre kilometres kilogram kilograms gram grams mph kmh kph").split()

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = np.where(_KEEP, _BYTE, np.uint64(0)).astype(np.uint64)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;|"]] = True


def _folded(text: str) -> str:
    """``text`` with the case of its letters beyond Latin-1 folded, as well as those whose capital is beyond or two letters."""
    return text if text.isascii() else _OTHER_CASE.sub(lambda m: m[0].casefold(), text)


def _raw_words(texts: list):
    """(hash, digit first, capital first, opens a sentence) of the words that hold a letter or digit, and each text's bounds."""
    raw = [_folded(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = ~_SPACE[buf]
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    if not len(starts):
        empty = np.zeros(0, bool)
        return np.zeros(0, np.uint64), empty, empty, empty, np.zeros(len(texts) + 1, np.int64)
    base = starts[0]
    buf, word, starts, ends = buf[base:], word[base:], starts - base, ends - base
    spans = np.diff(np.append(starts, len(buf)))
    keep = _KEEP[buf]
    seen = np.cumsum(keep) - keep
    place = seen - np.repeat(seen[starts], spans)
    powers = np.cumprod(np.full(int(place.max()) + 2, _STEP | np.uint64(1), np.uint64))
    follow = np.append(buf[1:], 10)
    folded = _VALUE[buf].copy()
    latin = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
    folded[latin] = _VALUE[buf[latin] + 0x20]  # À to Þ as à to þ
    h = mix64(np.add.reduceat(folded * powers[place], starts))
    opening = keep & (place == 0)
    digit = np.logical_or.reduceat(opening & (buf >= 48) & (buf < 58), starts)
    capital = np.logical_or.reduceat(opening & (((buf >= 65) & (buf < 91)) | ((buf == 0xC3) & (follow >= 0x80) & (follow <= 0x9E))), starts)
    last = starts + np.add.reduceat(word.astype(np.int64), starts) - 1
    stop = _STOP[buf[last]] | np.logical_or.reduceat(buf == 10, starts)
    opens = np.concatenate(([True], stop[:-1]))
    some = np.add.reduceat(keep.astype(np.int64), starts) > 0
    opens[1:] |= ~some[:-1]  # after a bar, a dash or the like
    bounds = np.concatenate(([0], np.cumsum(some)))[np.concatenate(([0], np.searchsorted(starts, ends)))]
    return h[some], digit[some], capital[some], opens[some], bounds


_known_units = np.sort(_raw_words([" ".join(UNITS)])[0])


def templates(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, template token hashes, slot values or 0, whether a literal) of each text."""
    for i, typed, _ in readings(texts):
        yield i, *typed


def readings(texts: list) -> Iterator[tuple[int, tuple, tuple]]:
    """(index, template, folded template) of each text: token hashes, slot values or 0, whether a literal; the folded one types no names and has the words' hashes too."""
    for lo, hi in chunks(texts):
        h, digit, capital, opens, bounds = _raw_words(texts[lo:hi])
        first = np.zeros(len(h) + 1, bool)
        first[bounds] = True
        first = first[:-1]
        opens = opens | first
        unit = np.zeros(len(h), bool)
        unit[1:] = digit[:-1] & ~first[1:] & (_known_units[np.minimum(np.searchsorted(_known_units, h[1:]), len(_known_units) - 1)] == h[1:])
        name = capital & ~opens & ~digit & ~unit
        token = np.where(digit, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
        literal = ~(digit | unit | name)
        kept = ~(digit | unit)
        plain, plain_bounds = (np.where(digit, NUMBER, np.where(unit, UNIT, h)), np.where(kept, np.uint64(0), h), kept, h), bounds
        # runs of names are one token, whose value is made of all of them
        follows = np.zeros(len(h), bool)
        follows[1:] = name[1:] & name[:-1] & ~first[1:]
        run = np.cumsum(~follows) - 1
        value = np.where(literal, np.uint64(0), h)
        if follows.any():
            heads = np.flatnonzero(~follows)
            place = np.arange(len(h)) - heads[run]
            value = np.where(literal[heads], np.uint64(0), mix64(np.add.reduceat(value * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), heads)))
            token, literal = token[heads], literal[heads]
            bounds = np.append(run, len(heads))[bounds] if len(h) else bounds
        for i, (a, b, c, d) in enumerate(zip(bounds[:-1], bounds[1:], plain_bounds[:-1], plain_bounds[1:])):
            yield lo + i, (token[a:b], value[a:b], literal[a:b]), tuple(x[c:d] for x in plain)


def _rolled(token: np.ndarray, width: int) -> np.ndarray:
    n = len(token) - width + 1
    return sum((token[k:k + n] * _PLACE[k] for k in range(1, width)), token[:n] * _PLACE[0] + np.uint64(width))


def window_hashes(token: np.ndarray, literal: np.ndarray, width: int, exact: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows that hold enough words; with ``exact``, the words' hashes, also of the others, by their words."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _rolled(token, width)
    words = np.cumsum(np.concatenate(([0], literal)))
    enough = words[width:] - words[:n] >= min(LITERAL, width - 1)
    if exact is None:
        at = np.flatnonzero(enough)
        return at, mix64(h[at])
    if width < LEAST or not enough.all():
        enough &= width >= LEAST
        h = np.where(enough, h, _rolled(exact, width) ^ _EXACT)
    return np.arange(n), mix64(h)


def _windows(marked: np.ndarray | None, widths: list[int] | None, least: int):
    """Windows of both readings of texts; only those marked in the bitmap, if there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, nones, out = pdf["id"].to_numpy(), pdf["none"].to_numpy(), []
            for i, *both in readings(pdf["text"].tolist()):
                for folded, (token, value, literal, *exact) in enumerate(both):
                    if len(token) < (max(1, least) if folded else max(LEAST, least)):
                        continue
                    for width in widths or [min(WINDOW, len(token))]:
                        at, h = window_hashes(token, literal, width, *exact)
                        if folded:
                            h = h ^ _FOLDED
                        if marked is not None:
                            cell = (h >> np.uint64(64 - BITS)).astype(np.int64)
                            hit = (marked[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                            at, h = at[hit], h[hit]
                        if len(at):
                            out.append((ids[i], bool(folded), width, at, h, [value[k:k + width].view(np.int64) for k in at], nones[i]))
            if out:
                n = [len(o[3]) for o in out]
                yield pd.DataFrame({
                    "id": np.repeat([o[0] for o in out], n), "none": np.repeat([o[6] for o in out], n), "folded": np.repeat([o[1] for o in out], n), "width": np.repeat([o[2] for o in out], n),
                    "pos": np.concatenate([o[3] for o in out]), "window": np.concatenate([o[4] for o in out]).view(np.int64), "slots": [x for o in out for x in o[5]]})

    return run


_SCHEMA = "id long, none boolean, folded boolean, width int, pos long, window long, slots array<long>"


def contaminated(spark: SparkSession, df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", cover: float = COVER,
                 run: int = RUN, least: int = LEAST) -> DataFrame:
    """One row per contaminated document and item: id, item, n_windows, coverage, kind, text_hash (of documents without id, else null).

    A document is contaminated by ``cover`` of an item's windows or by ``run`` of its running words (WINDOW at least).
    """
    scratch = Scratch(spark, "decontaminate")
    bounded_batches(spark)
    key = F.col(id_col).cast("long")
    docs = df.select(F.coalesce(key, F.xxhash64(text_col)).alias("id"), key.isNull().alias("none"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.lit(False).alias("none"), F.col(item_text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    items = scratch.write(items.mapInPandas(tidy(_windows(None, None, least)), _SCHEMA), "items")
    # the bitmap: at most 2**BITS / 64 words reach the driver, whatever the benchmark
    cell = F.shiftrightunsigned("window", 64 - BITS)
    words = items.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 AS int)))").alias("bits")).toPandas()
    marked = np.zeros(1 << BITS - 6, np.int64)
    marked[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    found = scratch.write(docs.mapInPandas(tidy(_windows(marked.view(np.uint8), widths, least)), _SCHEMA), "found")

    i, d = items.toDF("item", "o", "f", "w", "ipos", "window", "islots"), found.toDF("id", "none", "folded", "width", "pos", "window", "dslots")
    met = d.join(i, "window").where("f = folded").select("id", "none", "item", "folded", (F.col("pos") - F.col("ipos")).alias("offset"), "ipos", "islots", "dslots")
    met = scratch.write(met, "met")
    diagonal = ["id", "none", "item", "folded", "offset"]
    slots = met.select(*diagonal, F.explode(F.arrays_zip("islots", "dslots")).alias("s")).where("s.islots <> 0 OR s.dslots <> 0").select(*diagonal, "s.islots", "s.dslots").distinct()
    slots = slots.groupBy(*diagonal, "islots").agg(F.count("*").alias("values"), F.max(F.col("islots") != F.col("dslots")).alias("changed"))
    slots = slots.groupBy(*diagonal).agg(F.max("values").alias("values"), F.max("changed").alias("changed"))
    # windows without a change count on any diagonal
    steady = met.join(slots, diagonal, "left").where("coalesce(values, 1) = 1 OR islots = dslots").withColumn("changed", F.expr("changed AND values = 1"))
    total = items.groupBy(F.col("id").alias("item"), "folded").agg(F.count("*").alias("windows"))
    out = steady.groupBy("id", "none", "item", "folded").agg(F.countDistinct("ipos").alias("n_windows"), F.max(F.coalesce("changed", F.lit(False))).alias("changed")).join(total, ["item", "folded"])
    out = out.withColumn("coverage", F.col("n_windows") / F.col("windows"))
    # the reading that covers more; at a tie the one without changes, then the one with names
    rank = F.struct("coverage", (~F.col("changed")).alias("same"), (~F.col("folded")).alias("named"))
    out = out.groupBy("id", "none", "item").agg(F.max_by(F.struct("n_windows", "coverage", "changed"), rank).alias("best")).select("id", "none", "item", "best.*")
    same = met.where(F.col("folded") & (F.col("islots") == F.col("dslots")) & (F.size("islots") == WINDOW)).select("id", "none", "item", "offset", "ipos").distinct()
    same = same.withColumn("start", F.col("ipos") - F.row_number().over(Window.partitionBy("id", "none", "item", "offset").orderBy("ipos")))
    runs = same.groupBy("id", "none", "item", "offset", "start").count().where(F.col("count") + WINDOW - 1 >= run).select("id", "none", "item", F.lit(True).alias("ran")).distinct()
    out = out.join(runs, ["id", "none", "item"], "left").where((F.col("coverage") >= cover) | F.col("ran"))
    out = out.withColumn("changed", F.col("changed") & (F.col("coverage") >= cover))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias(id_col), F.col("item").alias(item_col), "n_windows", "coverage",
        F.when(F.col("changed"), F.lit("reparameterised")).otherwise(F.lit("verbatim")).alias("kind"), F.when(F.col("none"), F.col("id")).alias("text_hash"))


def decontaminate(spark: SparkSession, df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``df`` without its contaminated documents."""
    found = contaminated(spark, df, benchmark, id_col, text_col, **names).select(F.col(id_col).cast("long").alias("bad"), "text_hash").distinct()
    bad = Scratch(spark, "decontaminated").write(found, "bad")
    kept = without_ids(df.where(F.col(id_col).isNotNull()), id_col, bad.select("bad"), "bad")
    nameless = df.where(F.col(id_col).isNull()).withColumn("__hash", F.xxhash64(text_col))
    return kept.unionByName(without_ids(nameless, "__hash", bad.select("text_hash"), "text_hash").drop("__hash"))
