"""Benchmark decontamination over a distributed positional inverted index.

The index holds one posting (term, document, position) for every place where a document has a
term that some test item has; other terms can never be asked for. It is written once, sorted by term
within each block of documents, so that the list of a rare term is a few row groups.

Search starts from the rarest terms. Of every window of an item (`width` consecutive words, or the whole
of a shorter item) the two terms with the shortest lists are taken; the rarest one's postings give
alignments (document, item, shift), and the next one's list, moved by its offset, is intersected
with them on (term, document, position). Where the partner stands within `slack` words of its place, the item is near if all
words of a window do so, each within `slack` of its place.
Aligned ones are then intersected with the lists of all the item's terms, and runs of `width` matches are exact
phrase occurrences. No list is gathered: every intersection is an equi-join whose key has
document and position, so a hot term or item does not make a hot key.

Rows equal in id and text share their postings and each get their row; a null id is one more id. A null or
empty text has no words. Items with a null id or no words match nothing; items repeated under one id
count as one item. Terms are compared by 64-bit hash. Columns other than id and text are not read. All steps
are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillfloor.llm.common import stage, text_rows, word_array

WIDTH = 13
DOC = ("doc", "text_hash")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, its non-null stand-in `doc`, text and text hash: with the hash, the stand-in is safe."""
    return text_rows(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text"
    )


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (its text is in the key too), item_id, n, i, word and term of every word of every item."""
    return (
        items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
        .filter(F.col("item_id").isNotNull())
        .distinct()
        .select("item_id", F.xxhash64("item_id", "text").alias("item"), word_array(F.col("text")).alias("words"))
        .select("item_id", "item", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
        .withColumn("term", F.xxhash64("word"))
    )


def positional_index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc, text_hash, pos) of the given terms (word, term) over whole texts."""
    places = rows.filter(F.col("text").isNotNull()).select(*DOC, F.posexplode(word_array(F.col("text"))).alias("pos", "word"))
    return places.join(terms, "word").select("term", *DOC, "pos").sortWithinPartitions("term", *DOC, "pos")


def windows(terms: DataFrame, width: int) -> DataFrame:
    """(item, first, i, term): the words of every window, at most `width` rows each."""
    span = F.least(F.col("n"), F.lit(width))
    low = F.greatest(F.lit(0), F.col("i") - span + 1)
    high = F.least(F.col("i"), F.col("n") - span)
    return terms.select("item", F.explode(F.sequence(low, high)).alias("first"), "i", "term", "word")


def anchors(index: DataFrame, terms: DataFrame, width: int) -> DataFrame:
    """(item, i1, term1, i2, term2): the two rarest terms of every window that can occur."""
    lengths = index.groupBy("term").agg(F.count("*").alias("postings"))
    ranked = (
        windows(terms, width)
        .join(lengths, "term", "left")
        .groupBy("item", "first")
        # at most `width` words in a group
        .agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "i", "term"))), 1, 2).alias("two"))
        .filter(F.col("two")[0]["postings"] > 0)
    )
    last = F.col("two")[F.size("two") - 1]
    return ranked.select(
        "item", F.col("two")[0]["i"].alias("i1"), F.col("two")[0]["term"].alias("term1"),
        last["i"].alias("i2"), last["term"].alias("term2"),
    ).distinct()


def alignments(index: DataFrame, rarest: DataFrame, slack: int = 0) -> DataFrame:
    """(doc, text_hash, item, shift, off): where the two rarest terms meet, `off` words from their distance."""
    first = index.join(rarest, index["term"] == rarest["term1"]).select(
        *DOC, "item", (F.col("pos") - F.col("i1")).alias("shift"), "term2", "i2"
    )
    wanted = first.select(
        *DOC, "item", "shift", F.col("term2").alias("term"), F.explode(F.sequence(F.lit(-slack), F.lit(slack))).alias("off"),
        (F.col("shift") + F.col("i2")).alias("at"),
    ).select(*DOC, "item", "shift", "term", "off", (F.col("at") + F.col("off")).alias("pos"))
    second = index.join(rarest.select(F.col("term2").alias("term")).distinct(), "term")
    return wanted.join(second, ["term", *DOC, "pos"]).select(*DOC, "item", "shift", "off").distinct()


def exact_matches(index: DataFrame, aligned: DataFrame, terms: DataFrame, width: int) -> DataFrame:
    """(doc, text_hash, item, low, high): maximal runs of document words inside occurrences of windows."""
    return matches(index, aligned.filter(F.col("off") == 0), terms, width, 0)


def matches(index: DataFrame, aligned: DataFrame, terms: DataFrame, width: int, slack: int) -> DataFrame:
    """(doc, text_hash, item, low, high): places of maximal runs of item words that hold a window, each within `slack` of its place."""
    aligned = aligned.drop("off").distinct()
    expected = (
        aligned.join(terms.select("item", "n", "i", "term"), "item")
        .withColumn("off", F.explode(F.sequence(F.lit(-slack), F.lit(slack))))
        .withColumn("pos", F.col("shift") + F.col("i") + F.col("off"))
    )
    near = index.join(aligned.select(*DOC).distinct(), list(DOC), "left_semi")
    matched = expected.join(near, ["term", *DOC, "pos"]).select(*DOC, "item", "shift", "n", "i").distinct()
    # one group is one item laid on one place of one document: at most the item's words
    along = Window.partitionBy(*DOC, "item", "shift").orderBy("i")
    return (
        matched.withColumn("run", F.col("i") - F.row_number().over(along))
        .groupBy(*DOC, "item", "shift", "n", "run")
        .agg(F.min("i").alias("a"), F.max("i").alias("b"))
        .filter(F.col("b") - F.col("a") + 1 >= F.least(F.col("n"), F.lit(width)))
        .select(*DOC, "item", (F.col("shift") + F.col("a")).alias("low"), (F.col("shift") + F.col("b")).alias("high"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = 2, share: int = 20) -> DataFrame:
    """One row for each row of docs: its xxhash64(text), words, words hit, items with occurring windows, items near, contaminated.

    contaminated: a word is hit and `share` times the hit words reach the words.
    """
    rows = keyed(docs)
    terms = stage(item_terms(items))
    index = stage(positional_index(rows, terms.select("word", "term").distinct()))
    rarest = stage(anchors(index, terms, width))
    aligned = stage(alignments(index, rarest, slack))
    runs = stage(exact_matches(index, aligned, terms, width))
    near = matches(index, aligned, terms, width, slack) if slack else runs
    hits = (
        runs.select(*DOC, F.explode(F.sequence("low", "high")).alias("pos"))
        .distinct()
        .groupBy(*DOC)
        .agg(F.count("*").alias("n_hit"))
    )
    names = terms.select("item", "item_id").distinct()
    found = (
        runs.select(*DOC, "item").distinct().join(names, "item").groupBy(*DOC)
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    close = (
        near.select(*DOC, "item").distinct().join(names, "item").groupBy(*DOC)
        .agg(F.count_distinct("item_id").alias("n_near_items"))
    )
    seen = close.join(hits, list(DOC), "left").join(found, list(DOC), "left")
    none = F.expr("cast(array() as array<string>)")
    out = (
        rows.select("doc_id", *DOC, _word_count(F.col("text")).alias("n_words"))
        .join(seen, list(DOC), "left")
        .select(
            "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"),
            F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"),
        )
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _word_count(text: Column) -> Column:
    """As many words as word_array has."""
    return F.size(word_array(text)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near_items",
    )


# DuckDB: every window of every item as a joined string, against the strings of as many words of each document
ORACLE = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), bw as (
  select distinct item_id, k, array_to_string(w[s : s + k - 1], ' ') as phrase
  from (select item_id, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as s
        from b where len(w) > 0)
), hits as (
  select doc_id, s, k, item_id
  from (select doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') as phrase
        from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s
              from d, (select distinct k from bw) where len(w) >= k))
  join bw using (k, phrase)
), n as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + k)) as p from hits) group by doc_id
), i as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items
  from hits group by doc_id
), item as (
  select row_number() over () as item, item_id, w, len(w) as n from (select distinct item_id, w from b where len(w) > 0)
), t as (
  select item, n, i - 1 as i, w[i] as word from (select item, n, w, unnest(range(1, n + 1)) as i from item)
), dp as (
  select doc_id, p - 1 as pos, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)
  where w[p] in (select word from t)
), held as (
  select word, count(*) as postings from (select distinct doc_id, word, pos from dp) group by word
), win as (
  select item, first, i, word, coalesce(postings, 0) as postings,
    row_number() over (partition by item, first order by coalesce(postings, 0), i) as rank
  from (select item, i, word, unnest(range(greatest(0, i - least(n, 13) + 1), least(i, n - least(n, 13)) + 1)) as first from t)
  left join held using (word)
), two as (
  select distinct a.item, a.i as i1, a.word as w1, coalesce(z.i, a.i) as i2, coalesce(z.word, a.word) as w2
  from win a left join win z on z.item = a.item and z.first = a.first and z.rank = 2
  where a.rank = 1 and a.postings > 0
), slack as (
  select unnest(range(-2, 3)) as off
), laid as (
  select distinct x.doc_id, two.item, x.pos - i1 as shift
  from two join dp x on x.word = w1 cross join slack
  join dp y on y.doc_id = x.doc_id and y.word = w2 and y.pos = x.pos - i1 + i2 + off
), met as (
  select distinct laid.doc_id, item, shift, i, n
  from laid join t using (item) cross join slack
  join dp on dp.doc_id = laid.doc_id and dp.word = t.word and dp.pos = shift + i + off
), near as (
  select doc_id, count(distinct item_id) as n_near_items
  from (select doc_id, item, n, count(*) as run from (
          select *, i - row_number() over (partition by doc_id, item, shift order by i) as g from met)
        group by doc_id, item, shift, n, g having count(*) >= least(n, 13))
  join item using (item) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated,
  coalesce(n_near_items, 0) as n_near_items
from d left join n using (doc_id) left join i using (doc_id) left join near using (doc_id)
"""
