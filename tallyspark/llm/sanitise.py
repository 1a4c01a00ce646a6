"""PII: information-theoretic sanitisation. DataFrame functions only.

Fixed patterns find the protected values: addresses, IPs, card and phone numbers. What else gives them away is learnt from the whole
corpus: the words within NEAR code points of a value's occurrences are its context. A term t tells of an entity e
PMI(t; e) = log2(n(t, e) N / (n(t) n(e))) of its information IC(e) = log2(N / n(e)), with n(t, e) the occurrences of t in e's contexts, n(e)
the words of these contexts, n(t) the occurrences of t in the corpus, N its words. A term that leaves at most HIDDEN bits of IC(e)
and does so in SUPPORT different texts (copies that share their first context count once) discloses e; every occurrence of it is a span of kind term. Its generalisation is its
first STEM letters; where these, counted alike over the corpus, disclose no entity that the term does, the term is generalised to
them, else removed.

Positions are sums of the lengths of matches and of what lies between, in blocks of sqrt(n) matches, so long texts don't cost n^2. Two passes
read the texts where they lie, for values and contexts and for counts of terms; of all words only counts are shuffled. Without disclosing
terms there is no third. Contexts that repeat are counted before their words are taken apart.

Defined results: a null text is empty and without spans; rows that repeat are judged alike; a null doc_id is kept; an empty table gives
an empty result. Offsets are code points, ends exclusive. Words are cut at ASCII white space, punctuation at their ends is not part of
a term (PUNCTUATION), nor is case; terms have a letter, at least TERM characters and no "@", and overlap no base span. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, table, written

KINDS = ("email", "ip", "card", "phone", "term")
#: As Java patterns. Possessive quantifiers stand where giving back can't help; a run of characters is tried at its start, or where
#: the last match ended, only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What a text must hold for a pattern to be tried.
MARKS = {"email": "@", "phone": "+"}
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
PUNCTUATION = string.punctuation + "\u00ab\u00bb\u2018\u2019\u201c\u201d\u201e\u2013\u2014\u2026\u00a1\u00bf"
NEAR, SUPPORT, HIDDEN, TERM, STEM = 160, 3, 1.0, 2, 3
#: Tables of terms up to this number of rows are broadcast; beyond it the join is a shuffle.
BROADCAST_TERMS = 500_000


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of a number of at most 20 pass Luhn's test."""
    def at(padded: Column, i: int) -> Column:
        d = F.substring(padded, i, 1).cast("int")
        return d if i % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0)

    return let(F.lpad(digits(text), 20, "0"), lambda p: sum((at(p, i) for i in range(2, 21)), at(p, 1)) % 10 == 0)


def valid(kind: str, hit: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        return hit.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return let(F.length(digits(hit)), lambda n: n.between(14, 19)) & luhn(hit)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    return F.lit(True)


def prefix_sum(lengths: Column, width: Column, blocks: Column, i: Column) -> Column:
    """Sum of the first i lengths, whole blocks first."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    whole = (i / width).cast("int")
    return add(F.slice(blocks, F.lit(1), whole)) + add(F.slice(lengths, whole * width + 1, i - whole * width))


def placed(gaps: Column, hits: Column, keep) -> Column:
    """An array of (start, end, hit) of the hits that keep(hit) takes; gaps is what lies between them, one more."""
    lengths = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: (F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))).cast("long"))
    width = F.greatest(F.ceil(F.sqrt(F.size(hits).cast("double"))).cast("int"), F.lit(1))

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(x["hits"]) / x["width"]).cast("int")),
                             lambda b: F.aggregate(F.slice(x["lengths"], b * x["width"] + 1, x["width"]), F.lit(0).cast("long"), lambda p, q: p + q))
        kept = F.filter(F.sequence(F.lit(0), F.size(x["hits"]) - 1), lambda i: keep(F.get(x["hits"], i)))
        return let(F.struct(x["lengths"].alias("lengths"), x["width"].alias("width"), x["gaps"].alias("gaps"), x["hits"].alias("hits"), blocks.alias("blocks"), kept.alias("kept")),
                   lambda y: F.transform(y["kept"], lambda i: let(
                       prefix_sum(y["lengths"], y["width"], y["blocks"], i) + F.length(F.get(y["gaps"], i)),
                       lambda start: F.struct(start.alias("start"), (start + F.length(F.get(y["hits"], i))).alias("end"), F.get(y["hits"], i).alias("hit")))))

    return let(F.struct(gaps.alias("gaps"), hits.alias("hits"), lengths.alias("lengths"), width.alias("width")), of)


NOTHING = "array<struct<start:bigint,kind:int,end:bigint,hit:string>>"


def base_spans(text: Column) -> Column:
    """The base spans of a text: an array of (start, kind's place in KINDS, end, hit), in order."""
    def of_kind(k: int, kind: str) -> Column:
        found = lambda hits: F.transform(placed(F.split(text, PATTERNS[kind], -1), hits, lambda h: valid(kind, h)),
                                         lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit")))
        hits, none = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0), F.array().cast("array<string>")
        return let(F.when(F.contains(text, F.lit(MARKS[kind])), hits).otherwise(none) if kind in MARKS else hits,
                   lambda hits: F.when(F.exists(hits, lambda h: valid(kind, h)), found(hits)).otherwise(F.array().cast(NOTHING)))

    return F.array_sort(F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS[:4])]))


def term_of(word: Column) -> Column:
    """A word's term: lower case, without punctuation at its ends."""
    return F.btrim(F.lower(word), F.lit(PUNCTUATION))


def is_term(term: Column) -> Column:
    return (F.length(term) >= TERM) & ~F.contains(term, F.lit("@")) & term.rlike(r"\p{L}")


def stem_of(term: Column) -> Column:
    return F.substring(term, 1, STEM)


def words_of(text: Column) -> Column:
    """Words; empty strings, where white space starts or ends the text, too."""
    return F.split(text, GAP, -1)


def terms_in(docs: DataFrame, *others: Column) -> DataFrame:
    """A row for each word of docs(text): term, others."""
    return docs.select(*others, F.explode(words_of(F.lower("text"))).alias("word")).select(
        F.btrim("word", F.lit(PUNCTUATION)).alias("term"), *[c for c in ("key",) if others])


def contexts(text: Column, spans: Column) -> Column:
    """An array of (entity, words): the terms of the whole words within NEAR code points of each span."""
    def side(s: Column) -> Column:
        low = F.greatest(s["start"] - NEAR, F.lit(0)).cast("int")
        # a piece that begins or ends within a word may be cut: its first or last word is dropped
        left = F.when(low > 0, F.regexp_replace(F.substring(text, low + 1, s["start"].cast("int") - low), rf"^{WORD}", "")).otherwise(
            F.substring(text, F.lit(1), s["start"].cast("int")))
        right = F.substring(text, (s["end"] + 1).cast("int"), F.lit(NEAR))
        right = F.when(F.length(right) == NEAR, F.regexp_replace(right, rf"{WORD}$", "")).otherwise(right)
        # what touches the span is part of no word
        left, right = F.regexp_replace(left, rf"{WORD}$", ""), F.regexp_replace(right, rf"^{WORD}", "")
        return F.filter(F.transform(words_of(F.concat_ws(" ", left, right)), term_of), is_term)

    return F.transform(spans, lambda s: F.struct(F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lower(s["hit"])).alias("entity"),
                                                 side(s).alias("words")))


def sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_TERMS else df


def disclosing(docs: DataFrame, seen: DataFrame, hidden: float = HIDDEN, support: int = SUPPORT) -> DataFrame:
    """docs(text), seen(contexts) -> term, action (generalise or remove), stem: a written table of the terms that disclose an entity."""
    near = (seen.select("key", F.explode("contexts").alias("c")).groupBy("key", "c.entity", "c.words").agg(F.count(F.lit(1)).alias("n"))
            .where(F.size("words") > 0).withColumn("context", F.min(F.md5(F.array_join("words", " "))).over(Window.partitionBy("key", "entity")))
            .groupBy("entity", "words", "context").agg(F.sum("n").alias("n")))
    near = written(near, "contexts")
    entities = near.groupBy("entity").agg(F.sum(F.col("n") * F.size("words")).alias("n_e"), F.countDistinct("context").alias("different"))
    entities = written(entities.where(F.col("different") >= support), "entities")
    told = near.join(entities, "entity").select("entity", "n", "n_e", "context", F.explode("words").alias("term"))
    pairs = (told.groupBy("entity", "term", "context").agg(F.sum("n").alias("n"), F.first("n_e").alias("n_e"))
             .groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("different"), F.first("n_e").alias("n_e")))
    pairs = written(pairs.withColumn("stem", stem_of(F.col("term"))), "pairs")
    wanted = written(pairs.where(F.col("different") >= support).select("stem", "term").distinct(), "wanted")
    stems = written(wanted.groupBy("stem").agg(F.collect_set("term").alias("terms")), "stems")
    # one count of all words with wanted stems, wanted terms apart
    listed = (terms_in(docs).withColumn("stem", stem_of(F.col("term"))).join(sized(stems, stems.count()), "stem").where(is_term(F.col("term")))
              .groupBy("stem", F.when(F.array_contains("terms", F.col("term")), F.col("term")).alias("term")).agg(F.count(F.lit(1)).alias("n_t")))
    counts = written(listed, "term-counts")
    total = seen.agg(F.sum("n_words")).first()[0] or 0
    left_over = lambda n, n_with: F.log2(n / F.least(n_with, n))  # noqa: E731  IC(e) - PMI: log2(n(t) / n(t, e)), whatever N and n(e)
    some = F.log2(F.lit(float(max(total, 1))) / F.col("n_e")) > hidden  # what has no more information can't be hidden
    told = (pairs.where(F.col("different") >= support).join(counts.where("term is not null").select("term", "n_t"), "term")
            .where(some & (left_over(F.col("n_t"), F.col("n_te")) <= hidden)).select("entity", "term", "stem"))
    told = written(told, "told")
    by_stem = (pairs.groupBy("entity", "stem").agg(F.sum("n_te").alias("n_se"))
               .join(counts.groupBy("stem").agg(F.sum("n_t").alias("n_s")), "stem")
               .select("entity", "stem", (left_over(F.col("n_s"), F.col("n_se")) <= hidden).alias("still")))
    out = written(told.join(by_stem, ["entity", "stem"], "left").groupBy("term", "stem")
                  .agg(F.max(F.coalesce("still", F.lit(True))).alias("still"))
                  .select("term", "stem", F.when(F.col("still") | (F.length("term") <= STEM), "remove").otherwise("generalise").alias("action")), "disclosing")
    discard(near, entities, pairs, wanted, stems, counts, told)
    return out


def term_spans(text: Column, terms: Column, base: Column) -> Column:
    """An array of (start, kind, end, hit) of the terms' occurrences in a text that overlap no base span; hit is the term."""
    words = placed(F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.array_contains(terms, term_of(w)))
    lead = lambda w: F.length(w) - F.length(F.ltrim(w, F.lit(PUNCTUATION)))
    tail = lambda w: F.length(w) - F.length(F.rtrim(w, F.lit(PUNCTUATION)))
    spans = F.transform(words, lambda s: F.struct((s["start"] + lead(s["hit"])).alias("start"), F.lit(4).alias("kind"), (s["end"] - tail(s["hit"])).alias("end"),
                                                  term_of(s["hit"]).alias("hit")))
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def found(docs: DataFrame, hidden: float = HIDDEN, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(a written table of doc_id, key (digest of the text), base and terms (arrays of spans) of each row; the disclosing terms)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.sha2("text", 256))
    first = docs.select("doc_id", key.alias("key"), base_spans(F.col("text")).alias("base"), "text")
    seen = written(first.select("doc_id", "key", "base", F.size(F.array_remove(words_of(F.col("text")), "")).cast("long").alias("n_words"), F.when(F.size("base") > 0, contexts(F.col("text"), F.col("base"))).otherwise(
        F.array().cast("array<struct<entity:string,words:array<string>>>")).alias("contexts")), "base")
    terms = disclosing(docs, seen, hidden, support)
    n = terms.count()
    if not n:
        return seen.select("doc_id", "key", "base", F.array().cast(NOTHING).alias("terms")), terms
    hit = written(terms_in(docs.withColumn("key", key), F.col("key")).join(sized(terms.select("term"), n), "term").distinct().groupBy("key").agg(F.collect_set("term").alias("own")), "hit")
    with_terms = docs.withColumn("key", key).join(sized(hit, hit.count()), "key").select("key", term_spans(F.col("text"), F.col("own"), base_spans(F.col("text"))).alias("terms"))
    marks = written(with_terms.groupBy("key").agg(F.max("terms").alias("terms")), "marks")  # texts with one key are equal
    out = written(seen.drop("contexts", "n_words").join(marks, "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast(NOTHING))), "spans")
    discard(seen, hit, marks)
    return out, terms


def sanitised(docs: DataFrame, hidden: float = HIDDEN, support: int = SUPPORT) -> DataFrame:
    """docs(doc_id, text, ...) -> the same rows with text sanitised: base spans become [EMAIL], [IP], [CARD] or [PHONE], disclosing terms their
    generalisation, or nothing. Of overlapping base spans the first names the whole stretch."""
    spans, terms = found(docs, hidden, support)
    short = terms.where("action = 'generalise'").select(F.col("term").alias("hit"), F.concat("stem", F.lit("*")).alias("short"))
    every = spans.groupBy("key").agg(F.max("base").alias("base"), F.max("terms").alias("terms")).where("size(base) + size(terms) > 0")
    pieces = every.select("key", F.explode(F.concat("base", "terms")).alias("s")).select("key", "s.*")
    named = pieces.join(sized(short, short.count()), "hit", "left").withColumn("by", F.when(F.col("kind") < 4, F.concat(F.lit("["), F.upper(F.element_at(
        F.array(*map(F.lit, KINDS)), F.col("kind") + 1)), F.lit("]"))).otherwise(F.coalesce("short", F.lit(""))))
    cuts = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "by"))).alias("cuts"))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(x: Column, s: Column) -> Column:
        more = F.concat(x["out"], F.array(F.substring(F.col("text"), (x["at"] + 1).cast("int"), (s["start"] - x["at"]).cast("int")), s["by"]))
        fits = s["start"] >= x["at"]
        return F.struct(F.when(fits, more).otherwise(x["out"]).alias("out"), F.greatest(x["at"], s["end"]).alias("at"))

    rest = lambda x: F.concat(F.array_join(x["out"], ""), F.substring(F.col("text"), (x["at"] + 1).cast("int"), F.length("text")))
    new = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.aggregate("cuts", state, step, rest))
    return (docs.withColumn("__key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(cuts.withColumnRenamed("key", "__key"), "__key", "left")
            .select(*[new.alias("text") if c == "text" else F.col(c) for c in docs.columns]))


def op11_private(spark, sf_dir: str) -> DataFrame:
    spans, _ = found(table(spark, sf_dir, "documents"))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def _sql_kind(k: int) -> str:
    p = SQL_PATTERNS[KINDS[k]]
    return f"SELECT rid, {k} AS kind, regexp_extract_all(text, '{p}') AS h, regexp_split_to_array(text, '{p}') AS g FROM d"


SQL_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SQL_PUNCTUATION = PUNCTUATION.replace("'", "''")


def _sql_term(word: str) -> str:
    return f"trim(lower({word}), '{SQL_PUNCTUATION}')"


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
k AS ({' UNION ALL '.join(map(_sql_kind, range(4)))}),
u AS (SELECT rid, kind, h, g, unnest(range(1, len(h) + 1)) AS i FROM k WHERE len(h) > 0),
v AS (SELECT rid, kind, h[i] AS hit, regexp_replace(h[i], '[^0-9]', '', 'g') AS digits,
             CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM u),
base AS (SELECT rid, kind, hit, start, start + length(hit) AS stop FROM v WHERE CASE kind WHEN 0 THEN TRUE WHEN 1 THEN regexp_full_match(hit, '{PART}\\.{PART}\\.{PART}\\.{PART}')
  WHEN 3 THEN length(digits) BETWEEN 10 AND 15 ELSE length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, 21), lambda j: CASE WHEN j % 2 = 0
   THEN CAST(substr(lpad(digits, 20, '0'), j, 1) AS INTEGER) ELSE 2 * CAST(substr(lpad(digits, 20, '0'), j, 1) AS INTEGER) - 9 * (substr(lpad(digits, 20, '0'), j, 1) > '4')::INT END)) % 10 = 0 END),
sides AS (SELECT rid, kind, hit, substr(text, GREATEST(start - {NEAR}, 0) + 1, start - GREATEST(start - {NEAR}, 0)) AS l, substr(text, stop + 1, {NEAR}) AS r, start > {NEAR} AS cut FROM base JOIN d USING (rid)),
words AS (SELECT rid, ['email', 'ip', 'card', 'phone'][kind + 1] || ':' || lower(hit) AS entity, list_filter(list_transform(regexp_split_to_array(
   regexp_replace(CASE WHEN cut THEN regexp_replace(l, '^{WORD}', '') ELSE l END, '{WORD}$', '') || ' ' ||
   regexp_replace(CASE WHEN length(r) = {NEAR} THEN regexp_replace(r, '{WORD}$', '') ELSE r END, '^{WORD}', ''), '{GAP}'), lambda w: {_sql_term('w')}), lambda t: length(t) >= {TERM} AND NOT contains(t, '@') AND regexp_matches(t, '\\p{{L}}')) AS words FROM sides),
near AS (SELECT entity, words, MIN(md5(array_to_string(words, ' '))) OVER (PARTITION BY text, entity) AS context FROM words JOIN d USING (rid) WHERE len(words) > 0),
e AS (SELECT entity, SUM(len(words)) AS n_e, COUNT(DISTINCT context) AS contexts FROM near GROUP BY 1 HAVING COUNT(DISTINCT context) >= {SUPPORT}),
p AS (SELECT entity, term, substr(term, 1, {STEM}) AS stem, COUNT(*) AS n_te, COUNT(DISTINCT context) AS contexts FROM (SELECT entity, context, unnest(words) AS term FROM near SEMI JOIN e USING (entity)) GROUP BY 1, 2),
w AS (SELECT {_sql_term('w')} AS term FROM (SELECT unnest(regexp_split_to_array(text, '{GAP}')) AS w FROM d) WHERE w <> ''),
n AS (SELECT COUNT(*) AS n FROM w),
told AS (SELECT DISTINCT term FROM p JOIN e USING (entity), n WHERE p.contexts >= {SUPPORT} AND n.n > {2 ** HIDDEN} * n_e AND
  (SELECT COUNT(*) FROM w WHERE w.term = p.term) <= {2 ** HIDDEN} * LEAST(n_te, (SELECT COUNT(*) FROM w WHERE w.term = p.term))),
o AS (SELECT rid, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS h, regexp_split_to_array(text, '{WORD}') AS g FROM d
      WHERE EXISTS (SELECT 1 FROM told WHERE contains(lower(text), term)))),
q AS (SELECT rid, h[i] AS hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM o WHERE {_sql_term('h[i]')} IN (SELECT term FROM told)),
terms AS (SELECT rid, start + length(hit) - length(ltrim(hit, '{SQL_PUNCTUATION}')) AS start, start + length(rtrim(hit, '{SQL_PUNCTUATION}')) AS stop FROM q),
spans AS (SELECT rid, kind, start, stop FROM base UNION ALL SELECT rid, 4, start, stop FROM terms t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.start < t.stop AND t.start < b.stop)),
x AS (SELECT rid, {', '.join(f"COUNT(*) FILTER (kind = {k}) AS n_{KINDS[k]}" for k in range(4))},
  string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 4) AS base,
  string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY 1)
SELECT doc_id, {', '.join(f"COALESCE(n_{k}, 0) AS n_{k}" for k in KINDS[:4])}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN x USING (rid)"""
