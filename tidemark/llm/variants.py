"""Spelling variants: words one edit apart, each pointed at a far more frequent spelling.

Method: dynamic programming along sorted lists. In a sorted list of words, neighbouring words share
their longest common prefix (LCP), and with it the rows of the edit matrix against any other word;
rows are three cells wide, since more than one edit is never asked for. `scan` goes through a list
depth by depth: a run of words with one prefix has one row per query word, taken from the row of
the prefix one shorter, and a run whose row exceeds one edit everywhere is left out with all its words.

A list fits one task: two words one edit apart differ in one place, so they share everything before
or everything after it. A word of length L is listed under (length s, window [a, b)) for s = L, where
it can be found, and for s = L - 1, where it only asks; the words of a group agree outside the window,
and only the window is compared. Windows begin as the two halves of the word. A group of more than
`GROUP` code points is cut again into the halves of its window, until the window is one code point
wide; then a group holds no more words than the square of the alphabet. So no prefix or ending, however
common, makes a large group. A pair belongs to the window its first difference lies in and is
found once.

Rows: null texts hold no words; repeated documents count as often as they come; a document without
an id counts with the empty id; an empty table has no words; very long words only make the
windows longer (memory of a task grows with `GROUP` and the longest word). Ties of form go to the smallest
word in code-point order. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points of the windows of one group; larger groups are cut into smaller windows.
GROUP = 50_000
#: Code points compared at once in a task, in whole groups.
CHUNK = 100_000
PAIRS = "word string, n long, near string, near_n long"


def runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, run): each maximal run of at least `least` letters of each text, A-Z lower-cased."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))
    return docs.select("doc_id", F.explode(found).alias("run"))


def vocabulary(words: DataFrame, least: int = 1) -> DataFrame:
    """(word, n) of the words that come at least `least` times, from rows of `word`."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


# ── one edit ────────────────────────────────────────────────────────────────


def _points(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, one row each, padded with 0 (no word holds it where it is compared)."""
    out = np.zeros((len(words), width), dtype=np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scan(parts: list[str], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs one edit apart within a group: (asking row, found row, length of their common prefix).

    `parts` are sorted by (group, part) and `width` or `width + 1` code points long; only those of
    `width` are found.
    """
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    points = _points(parts, width + 2)
    listed = np.flatnonzero(sizes == width)
    none = np.zeros(0, dtype=np.int64)
    if not len(listed):
        return none, none, none
    cells = points[listed, :width]
    differ = cells[1:] != cells[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.concatenate([[-1], np.where(group[listed][1:] == group[listed][:-1], lcp, -1)])

    begin = np.flatnonzero(lcp < 0)                            # first word of each run that shares `depth` code points
    lists = group[listed][begin]
    place = np.searchsorted(lists, group)
    ask = np.flatnonzero((place < len(lists)) & (lists[np.minimum(place, len(lists) - 1)] == group))
    node = place[ask]
    row = np.tile(np.array([9, 0, 1], dtype=np.int8), (len(ask), 1)).T
    for depth in range(1, width + 1):
        deeper = np.flatnonzero(lcp < depth)
        first = np.searchsorted(deeper, begin)
        many = np.diff(np.append(first, len(deeper)))[node]
        at = np.repeat(np.arange(len(node)), many)
        child = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[node][at]
        letter, query = cells[deeper[child], depth - 1], ask[at]
        low, mid, high = row[0][at], row[1][at], row[2][at]
        new_low = np.minimum(low + (points[query, depth - 2] != letter), mid + 1)
        new_mid = np.minimum(np.minimum(mid + (points[query, depth - 1] != letter), high + 1), new_low + 1)
        new_high = np.minimum(high + (points[query, depth] != letter), new_mid + 1)
        live = np.flatnonzero((new_low <= 1) | (new_mid <= 1) | (new_high <= 1))
        begin, node, ask = deeper, child[live], query[live]
        row = np.stack([new_low[live], new_mid[live], new_high[live]]).astype(np.int8)
    found = listed[begin[node]]
    edits = np.where(sizes[ask] == width, row[1], row[2])
    ask, found = ask[edits == 1], found[edits == 1]
    common = points[ask, :width] != points[found, :width]
    return ask, found, np.where(common.any(axis=1), common.argmax(axis=1), width) if width else np.zeros(len(ask), dtype=np.int64)


def _pairs(rows: pa.Table) -> pa.RecordBatch | None:
    """Pairs of whole groups, sorted by (width, key, head, tail, part)."""
    if rows.num_rows < 2:
        return None
    change = np.zeros(rows.num_rows - 1, dtype=bool)
    for c in ("width", "key", "head", "tail"):
        col = rows[c].combine_chunks()
        change |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    group = np.concatenate([[0], np.cumsum(change)])
    several = np.bincount(group)[group] > 1
    rows, group = rows.filter(pa.array(several)), group[several]
    if not rows.num_rows:
        return None
    width = rows["width"].to_numpy()
    last = pc.equal(rows["tail"], "").to_numpy()
    asks, founds = [], []
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        ask, found, common = scan(rows["part"].take(pa.array(of)).to_pylist(), group[of], int(w))
        own = (common < w) | last[of[ask]]                     # the first difference lies in this window
        asks.append(of[ask[own]])
        founds.append(of[found[own]])
    ask, found = np.concatenate(asks), np.concatenate(founds)
    longer = np.flatnonzero(pc.utf8_length(rows["part"]).to_numpy()[ask] > width[ask])
    ask, found = np.concatenate([ask, found[longer]]), np.concatenate([found, ask[longer]])
    if not len(ask):
        return None
    word = pc.binary_join_element_wise(rows["head"], rows["part"], rows["tail"], "").combine_chunks()
    n = rows["n"].combine_chunks()
    ask, found = pa.array(ask), pa.array(found)
    return pa.RecordBatch.from_arrays([word.take(ask), n.take(ask), word.take(found), n.take(found)], names=["word", "n", "near", "near_n"])


def _scan_partition(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through a sorted partition in chunks of whole groups."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for b in source:
        held.append(b)
        weight += pc.sum(pc.add(b["width"], 1)).as_py() or 0
        if weight < CHUNK:
            continue
        rows = pa.Table.from_batches(held)
        key = rows["key"].to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        # arrays for one chunk stay bounded: whole groups, CHUNK code points each
        yield from _chunks(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
        weight = pc.sum(pc.add(rows.slice(cut)["width"], 1)).as_py() or 0
    if held:
        yield from _chunks(pa.Table.from_batches(held))


def _chunks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    key = rows["key"].to_numpy()
    upto = np.cumsum(rows["width"].to_numpy() + 1)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, rows.num_rows)
    start = 0
    while start < rows.num_rows:
        floor = upto[start - 1] if start else 0
        fits = ends[(ends > start) & (upto[ends - 1] <= floor + CHUNK)]
        end = int(fits[-1]) if len(fits) else int(ends[ends > start][0])
        out = _pairs(rows.slice(start, end - start))
        if out is not None:
            yield out
        start = end


def _listed(words: DataFrame, windows: Column) -> DataFrame:
    """(word, n, s, a, b, head, part, tail, width, key) of each window (array of s, a, b) of each word."""
    rows = words.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.*")
    size, keep = F.char_length("word"), F.col("s") - F.col("b")
    return rows.select(
        "word", "n", "s", "a", "b", F.substr("word", F.lit(1), F.col("a")).alias("head"),
        F.substr("word", F.col("a") + 1, size - keep - F.col("a")).alias("part"),
        F.substr("word", size - keep + 1, keep).alias("tail"), (F.col("b") - F.col("a")).alias("width")).withColumn(
        "key", F.xxhash64("s", "a", "b", "head", "tail"))


def _window(s: Column, a: Column, b: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def _halves(s: Column, a: Column, b: Column) -> Column:
    half = F.floor((a + b) / 2)
    return F.filter(F.array(_window(s, a, half), _window(s, half, b)), lambda w: w["a"] < w["b"])


def near(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, near, near_n): every two words of the vocabulary exactly one edit apart, both ways round."""
    size = F.char_length("word")
    level = _listed(vocabulary, F.concat(_halves(size, F.lit(0), size), _halves(size - 1, F.lit(0), size - 1)))
    ready = None
    while True:
        heavy = level.filter("width > 1").groupBy("key").agg(F.sum(F.col("width") + 1).alias("points")).filter(F.col("points") > group)
        heavy = written(heavy.select("key"), "variant-groups")
        if heavy.isEmpty():
            break
        fits = level.join(heavy, "key", "left_anti")
        ready = fits if ready is None else ready.unionByName(fits)
        # windows of one code point are not cut again, whatever their key
        split = level.join(heavy, "key", "left_semi")
        level = written(_listed(split.select("word", "n", _halves(F.col("s"), F.col("a"), F.col("b")).alias("ws")), F.col("ws")), "variant-windows")
    level = level if ready is None else ready.unionByName(level)
    rows = level.select("width", "key", "head", "tail", "part", "n")
    rows = rows.repartition("key").sortWithinPartitions("width", "key", "head", "tail", "part")
    return rows.mapInArrow(_scan_partition, PAIRS)


# ── forms ───────────────────────────────────────────────────────────────────


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): where the forms lead. Forms never lead in a circle; each round doubles the steps."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-roots")
    while not at.filter("moved").isEmpty():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
    return at.select("word", "root")


def grouped(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each (word, n).

    `form` is the most frequent word one edit away (the first in code-point order of equals), if it comes
    at least `ratio` times as often; `root` is where the forms lead, the word itself without any.
    """
    words = written(vocabulary.select("word", "n"), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    made = written(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "variant-forms")
    led = roots(made.filter("form is not null"))
    return made.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The contract's words: code points at least, occurrences at least, one run in DROP loses a code point.
LEAST, TIMES, DROP = 6, 5, 199


def typed(found: DataFrame) -> DataFrame:
    """(word) of each (doc_id, run): the run, in one of `DROP` cases without the code point its hash points at."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    with_h = found.select("run", F.crc32(named.cast("binary")).alias("h"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2, F.char_length("run")))
    return with_h.select(F.when(F.col("h") % DROP == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST)


def sql(table: str = "documents") -> str:
    """DuckDB twin: the checksum by its table of 256 entries, near words by the words both become when one code point goes."""
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: {step}) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM {table}),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= {LEAST} GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x)::BIGINT, 2),
      lambda i: (strpos('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)),
    lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
typed AS (
  SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= {TIMES}),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(DISTINCT other) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
led AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT led.word, forms.form FROM led JOIN forms ON led.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT led.word, led.at FROM led JOIN forms ON led.at = forms.word WHERE forms.form IS NULL)
SELECT forms.word, form, ends.at AS root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN ends USING (word)"""
