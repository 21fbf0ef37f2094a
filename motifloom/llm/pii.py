"""Personal data, and the words that give it away.

Only DataFrame functions are used. Base spans (e-mail, IP, card, phone) come
from patterns. The words of the documents that hold one are sanitised by how
much information they carry about it, wherever they stand: over the whole corpus, the pointwise mutual information
log2(n(t,e) N / (n(t) n(e))) of a word t and an entity e, as a share of the
entity's own information log2(N / n(e)), is the part of e that t discloses.
Words above the upper threshold are removed, words above the lower one are
generalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.durable import columns, durable, fresh

KINDS = ("email", "ip", "card", "phone")
#: Shares of an entity's information from which a word is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Different texts that must hold a word and an entity before that counts as evidence; of an entity in fewer documents, as many as those.
SUPPORT = 3

# The same matches as the documented patterns. Quantifiers are possessive where nothing that follows could
# use what they give back, so long runs need neither stack nor repeated scans; a run's later characters are not tried as starts.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": f"(?:\\\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "[+][0-9][ ().0-9-]+[0-9]",
}
_MAY = {
    "email": "contains(text, '@')",
    "ip": "text rlike '[0-9][.][0-9]++[.][0-9]++[.][0-9]'",
    "card": "text rlike '[0-9](?:[ -]?[0-9]){15}'",
    "phone": "text rlike '[+][0-9][ ().0-9-]'",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = f"transform(array({_DIGITS}), d -> length(d) between 16 and 19 and aggregate(sequence(1, length(d)), 0, (s, i) -> s + transform(array(cast(substring(d, length(d) - i + 1, 1) as int) * if(i % 2 = 0, 2, 1)), v -> if(v > 9, v - 9, v))[0]) % 10 = 0)[0]"
_HOLDS = {
    "email": "true",
    "ip": f"x.value rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) between 8 and 15",
}
#: A word between white space, of at least three letters and without closing punctuation.
_TERM = "(?<!\\\\S)\\\\p{L}{3,}+(?=[.,;:!?]*+(?!\\\\S))"
_SPAN = "struct<kind:int,start:bigint,end:bigint,value:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _running(a: str) -> str:
    """SQL: running sums of an array of bigint, in blocks, so that long arrays take time in proportion."""
    state = "struct<at:bigint,out:array<bigint>>"
    start = lambda base: f"cast(named_struct('at', {base}, 'out', array()) as {state})"
    block = f"slice({a}, cast(b * 512 + 1 as int), 512)"
    sums = f"transform(sequence(0, (size({a}) - 1) div 512), b -> aggregate({block}, 0L, (s, x) -> s + x))"
    bases = f"aggregate({sums}, {start('0L')}, (s, x) -> cast(named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))) as {state}), s -> s.out)"
    return f"flatten(transform({bases}, (base, b) -> aggregate({block}, {start('base')}, (s, x) -> cast(named_struct('at', s.at + x, 'out', concat(s.out, array(s.at + x))) as {state}), s -> s.out)))"


def _placed(pattern: str) -> str:
    """SQL: the matches of a pattern in ``text`` with their places, from the texts of all matches and of what lies between them."""
    parts = f"named_struct('hit', regexp_extract_all(text, '{pattern}', 0), 'gap', split(text, '{pattern}', -1))"
    steps = "transform(q.hit, (m, i) -> cast(length(q.gap[i]) + if(i > 0, length(q.hit[i - 1]), 0) as bigint))"
    placed = f"transform(array({steps}), a -> {_running('a')})[0]"
    spans = f"transform({placed}, (at, i) -> named_struct('start', at, 'end', at + length(q.hit[i]), 'value', q.hit[i]))"
    none = "cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"
    return f"transform(array({parts}), q -> if(size(q.hit) = 0, {none}, {spans}))[0]"


def _spans(kind: str) -> str:
    """SQL: the valid spans of a kind in ``text``."""
    found = f"cast(transform({_placed(_PATTERN[kind])}, x -> named_struct('kind', {KINDS.index(kind)}, 'start', x.start, 'end', x.end, 'value', x.value)) as array<{_SPAN}>)"
    return f"case when {_MAY[kind]} then filter({found}, x -> {_HOLDS[kind]}) else {_NONE} end"


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Texts (null: empty) with a key that rows of the same id and text share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, F.xxhash64(F.col("doc_id"), text).alias("row_key"), text.alias("text"))


def find_spans(docs: DataFrame) -> DataFrame:
    """Base spans: ``doc_id``, ``row_key``, ``found``, an array of kind, start, end and value, and, where it has any, ``text``."""
    found = F.expr(f"concat({', '.join(_spans(k) for k in KINDS)})")
    return _keyed(docs, "doc_id").select("doc_id", "row_key", found.alias("found"), "text").withColumn("text", F.when(F.size("found") > 0, F.col("text")))


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """Spans of words that disclose an entity of their document: ``row_key``, ``start``, ``end``, ``action``.

    All words of a document with an entity are candidates, and every occurrence
    of a disclosing word there is a span. n(t), n(e) and n(t,e) count documents
    of the whole corpus. Copies of one text are not evidence: of an entity's
    documents, ``support`` different texts must hold the word, or as many as
    the entity has documents if those are fewer.
    """
    n = found.count()
    holders = found.where(F.size("found") > 0).dropDuplicates(["row_key"])
    term = F.explode(F.expr(_placed(_TERM))).alias("t")
    words = durable(holders.select("row_key", F.xxhash64("text").alias("text_key"), term).select("row_key", "text_key", F.xxhash64(F.lower("t.value")).alias("h"), "t.start", "t.end"), "pii-words")

    # Documents that have a word, for every word of the corpus, by its hash.
    every = F.expr(f"transform(array_distinct(regexp_extract_all(lower(text), '{_TERM}', 0)), w -> xxhash64(w))")
    word_docs = _keyed(docs).select(F.explode(every).alias("h")).groupBy("h").agg(F.count("*").alias("n_t"))
    entities = holders.select("row_key", F.explode(F.expr("array_distinct(transform(found, x -> xxhash64(lower(x.value))))")).alias("entity"))
    entities = durable(entities, "pii-entities")
    entity_docs = entities.groupBy("entity").agg(F.count("*").alias("n_e"))

    # n(t,e) is at most n(e), so a word of more documents than this is below the lower threshold: such pairs are not made.
    rarity = F.col("n_t") <= F.col("n_e") * F.pow(F.lit(float(max(n, 1))) / F.col("n_e"), F.lit(1 - min(generalise, remove))) * (1 + 1e-9)
    held = words.groupBy("row_key", "h").agg(F.min("text_key").alias("text_key")).join(word_docs, "h")
    pairs = durable(held.join(entities.join(entity_docs, "entity"), "row_key").where(rarity).select("row_key", "text_key", "entity", "h", "n_t", "n_e"), "pii-pairs")
    judged = pairs.groupBy("entity", "h").agg(F.count("*").alias("n_te"), F.count_distinct("text_key").alias("texts"), F.min("n_t").alias("n_t"), F.min("n_e").alias("n_e"))
    judged = judged.where(F.col("texts") >= F.least(F.lit(support), F.col("n_e")))

    known = F.log2(n / F.col("n_e"))
    told = F.log2(F.col("n_te") * n / (F.greatest("n_t", "n_te") * F.col("n_e")))
    part = F.when(F.col("n_e") < n, told / known).otherwise(F.lit(0.0))
    action = F.when(part >= remove, F.lit("remove")).when(part >= generalise, F.lit("generalise"))
    judged = judged.select("entity", "h", action.alias("action")).where("action is not null")
    # A word that tells of two entities is removed if either asks for it.
    verdicts = pairs.join(judged, ["entity", "h"]).groupBy("row_key", "h").agg(F.max("action").alias("action"))
    return words.join(verdicts, ["row_key", "h"]).select("row_key", "start", "end", "action")


def sanitise(docs: DataFrame, rewrite: bool = True, **thresholds) -> DataFrame:
    """Find personal data and disclosing words.

    Returns the columns of ``docs`` (with ``rewrite``, ``text`` is the
    sanitised text; it stays null where it was) and ``pii_spans``, which
    replaces a column of that name: an array of
    kind, start and end (code points, end exclusive), kinds ``email``, ``ip``,
    ``card``, ``phone``, then ``generalise`` and ``remove``. In the text, base
    spans become ``<EMAIL>`` and so on, generalised words ``<TERM>`` and
    removed words nothing; overlapping spans are replaced once, as one.
    Without ``rewrite`` only ``doc_id`` and ``pii_spans`` are returned, and
    texts are never shuffled. Null and empty texts have no spans; repeated
    rows stay and get the same spans; an empty table gives an empty table.
    """
    found = durable(find_spans(docs), "pii-found")
    added = disclosing_terms(docs, found, **thresholds)
    more = added.groupBy("row_key").agg(F.expr("array_sort(collect_list(named_struct('kind', if(action = 'generalise', 4, 5), 'start', start, 'end', end)))").alias("more"))
    names = ", ".join(f"'{k}'" for k in (*KINDS, "generalise", "remove"))
    spans = f"transform(concat(transform(found, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end)), coalesce(more, cast(array() as array<struct<kind:int,start:bigint,end:bigint>>))), x -> named_struct('kind', array({names})[x.kind], 'start', x.start, 'end', x.end))"
    if not rewrite:
        return found.join(more, "row_key", "left").select("doc_id", F.expr(spans).alias("pii_spans"))
    own, key, told = fresh(docs, "own_key", "row_key", "spans")
    by_key = found.where(F.size("found") > 0).select("row_key", "found").dropDuplicates(["row_key"]).join(more, "row_key", "left").select(F.col("row_key").alias(key), F.expr(spans).alias(told))
    marked = docs.withColumn(own, F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))).join(by_key, F.col(own) == F.col(key), "left")
    text = F.when(F.col(told).isNull(), F.col("text")).otherwise(F.expr(_rewritten("text", told)))
    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    return marked.select(*[text.alias("text") if c == "`text`" else F.col(c) for c in columns(docs) if c != "`pii_spans`"], F.coalesce(told, empty).alias("pii_spans"))


def _rewritten(text: str, spans: str) -> str:
    """SQL: ``text`` with its spans replaced."""
    keep = "struct<at:bigint,out:array<struct<from:bigint,start:bigint,end:bigint,kind:string>>>"
    ordered = f"array_sort({spans}, (a, b) -> case when a.start != b.start then cast(sign(a.start - b.start) as int) else cast(sign(b.end - a.end) as int) end)"
    apart = f"aggregate({ordered}, cast(named_struct('at', 0L, 'out', array()) as {keep}), (s, x) -> cast(if(x.end <= s.at, s, named_struct('at', x.end, 'out', concat(s.out, array(named_struct('from', s.at, 'start', greatest(x.start, s.at), 'end', x.end, 'kind', x.kind))))) as {keep}))"
    mark = "case x.kind when 'remove' then '' when 'generalise' then '<TERM>' else concat('<', upper(x.kind), '>') end"
    return f"transform(array({apart}), s -> concat(array_join(transform(s.out, x -> concat(substring({text}, cast(x.from + 1 as int), cast(x.start - x.from as int)), {mark})), ''), substring({text}, cast(s.at + 1 as int))))[0]"


def span_digest(found: DataFrame) -> DataFrame:
    """Counts and the digests of ``pii_spans``: the base spans' SHA-256 and all spans as text."""
    joined = lambda which: F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*KINDS))
    counts = [F.expr(f"cast(size(filter(pii_spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
