"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, num=85, den=100)
    return out.withColumnRenamed("id", "doc_id")


ORACLES["op1_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.m), d.doc_id) AS component_id, coalesce(least(d.doc_id, m.m), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) m USING (doc_id)
"""


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"), digest="all")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


ORACLES["op2_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM n WINDOW w AS (PARTITION BY k ORDER BY c DESC, doc_id)
"""


#: A line goes where over so large a share of a source's pages have it, and so many pages at least.
LINE_RATIO, LINE_PAGES = 0.01, 3


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"), ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return out.select("doc_id", "source", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


ORACLES["op3_line_dedup"] = rf"""
WITH x AS (SELECT *, row_number() OVER () AS d FROM documents),
l AS (SELECT d, source, text, i, line, trim(line, E' \\t\\n\\x0b\\f\\r') AS bare FROM (SELECT d, source, text, generate_subscripts(y, 1) AS i, unnest(y) AS line FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS y FROM x))),
t AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
b AS (SELECT coalesce(source, '') AS host, bare, count(DISTINCT text) AS pages FROM l WHERE bare <> '' GROUP BY 1, 2 HAVING count(DISTINCT text) >= {LINE_PAGES}),
c AS (SELECT host, bare FROM b JOIN t USING (host) WHERE pages > {LINE_RATIO} * total),
k AS (SELECT l.d, l.i, l.line, c.bare IS NULL AS stays FROM l LEFT JOIN c ON c.host = coalesce(l.source, '') AND c.bare = l.bare),
j AS (SELECT d, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS kept FROM k GROUP BY d)
SELECT doc_id, source, CASE WHEN n_dropped > 0 THEN kept ELSE text END AS text, n_lines, n_dropped
FROM x JOIN j USING (d)
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    out = toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def public_bpe() -> tuple:
    """The byte-level BPE of the public tokenizers alone: the added token of byte_bpe_50k.json is text like any other."""
    import public_tokenizers

    from .packing import byte_bpe

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def public_tokenizer() -> tuple:
    """public_bpe with the added tokens: the same ids as byte_bpe_50k.json as it is, which the tests check."""
    import public_tokenizers

    from .packing import added_tokens, byte_bpe

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizer, window=2048, end_id=1).withColumnRenamed("id", "doc_id")


#: The mixture that the mixing query and the pipeline aim at: sources alike, large languages and topics held back.
TARGETS = {"source": None, "lang": 0.7, "topic": 0.9}
RATE, EVERY, TOLERANCE, TOPICS = 0.5, 5, 0.001, 3


def mixed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    from .mixing import mix, topic, topic_words

    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"), topic_words(docs, F.col("lang"), k=TOPICS))}
    return mix(docs, TARGETS, dims, rate=RATE, tolerance=TOLERANCE, every=EVERY, carry=carry)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", F.col("__tokens").alias("tokens"), F.round("__p", 6).alias("p"), F.round("__residual", 4).alias("residual"), F.col("__kept").alias("kept"))


def _mixing_sql() -> str:
    """The same in SQL: a recursion from look to look."""
    from .mixing import PROGRESS

    blank = r"[\x20\x09-\x0D]+"
    dims = list(TARGETS)

    def weight(dim: str) -> str:
        t = TARGETS[dim]
        if isinstance(t, dict):
            return f"CASE {dim} {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in t.items())} ELSE {t.get('other', 0.0)}::DOUBLE END"
        return "1.0::DOUBLE" if t is None else f"pow(sum(tokens)::DOUBLE, {t})"

    parts = []
    for d in dims:  # classes that lack most come first; the first scale under which the next class has enough holds
        parts.append(f"""h_{d} AS (SELECT {d}, sum(tokens)::DOUBLE AS has, {weight(d)} AS w FROM c GROUP BY {d}),
o_{d} AS (SELECT *, coalesce(sum(has) OVER o, 0) AS used, row_number() OVER (ORDER BY has / w, {d}) AS nth, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free FROM h_{d} WHERE w > 0 WINDOW o AS (ORDER BY has / w, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s_{d} AS (SELECT arg_min(({RATE} * (SELECT sum(tokens) FROM c) - used) / free, nth) FILTER (has / w >= ({RATE} * (SELECT sum(tokens) FROM c) - used) / free) AS scale FROM o_{d}),
t_{d} AS (SELECT {d}, least(has, w * coalesce(scale, 1e300)) AS t_{d} FROM h_{d}, s_{d})""")
    step = f"SELECT * FROM r WHERE res > {TOLERANCE} AND res <= last * {1 - PROGRESS}"
    for _ in range(EVERY):
        for d in dims:
            step = f"SELECT * EXCLUDE (own) REPLACE (CASE WHEN own > 0 THEN keep * t_{d} / own ELSE 0 END AS keep) FROM (SELECT *, sum(keep) OVER (PARTITION BY {d}) AS own FROM ({step}))"
        step = f"SELECT * REPLACE (least(keep, tokens::DOUBLE) AS keep) FROM ({step})"
    own = ", ".join(f"sum(keep) OVER (PARTITION BY {d}) AS own_{d}" for d in dims)
    off = ", ".join(f"CASE WHEN t_{d} > 0 THEN abs(own_{d} / t_{d} - 1) ELSE 0 END" for d in dims)
    gone = ", ".join(f"own_{d}" for d in dims)
    return f"""
WITH RECURSIVE x AS (
  SELECT doc_id, coalesce(source, 'other') AS source, coalesce(lang, 'other') AS lang, coalesce(text, '') AS t,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+') AS letters FROM documents),
g AS (SELECT lang, count(*) AS docs FROM x GROUP BY lang),
q AS (SELECT lang, word, count(*) AS df FROM (SELECT lang, unnest(list_distinct(letters)) AS word FROM x) WHERE length(word) BETWEEN 5 AND 20 GROUP BY ALL),
v AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY df DESC, word) AS k FROM q JOIN g USING (lang) WHERE df * 200 >= docs AND df * 10 <= docs),
a AS (SELECT word, row_number() OVER (ORDER BY min((lang, k))) AS r FROM v WHERE k <= {TOPICS} GROUP BY word),
b AS (SELECT doc_id, n, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, r) AS pick FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(letters) AS word FROM x) GROUP BY ALL) JOIN a USING (word)),
d AS (
  SELECT x.doc_id, source, lang, greatest(len(regexp_split_to_array(regexp_replace(t, '^{blank}|{blank}$', '', 'g'), '{blank}')), 1)::BIGINT AS tokens, coalesce(b.word, 'other') AS topic
  FROM x LEFT JOIN b ON b.doc_id = x.doc_id AND pick = 1),
c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL),
{", ".join(parts)},
w AS (SELECT c.*, tokens * {RATE}::DOUBLE AS keep, {", ".join(f"t_{d}" for d in dims)} FROM c {" ".join(f"JOIN t_{d} USING ({d})" for d in dims)}),
r AS (
  SELECT 0 AS look, 1e300 AS last, max(greatest({off})) OVER () AS res, * EXCLUDE ({gone}) FROM (SELECT *, {own} FROM w)
  UNION ALL
  SELECT look + 1, res, max(greatest({off})) OVER (), * EXCLUDE (look, last, res, {gone}) FROM (SELECT *, {own} FROM ({step}))),
p AS (SELECT source, lang, topic, keep / tokens AS p, res AS residual FROM r QUALIFY look = max(look) OVER ())
SELECT doc_id, tokens, round(p, 6) AS p, round(residual, 4) AS residual, ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < p AS kept
FROM d JOIN p USING (source, lang, topic)
"""


ORACLES["op6_mixing"] = _mixing_sql()


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_languages(docs))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract, fit_labeller

    pages = table(spark, sf_dir, "pages")
    out = extract(pages, fit_labeller(pages))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_main")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit_rules, quality_verdicts

    docs = table(spark, sf_dir, "documents")
    out = quality_verdicts(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *(F.col(f"__c_{c}").alias(c) for c in counts), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__rule").alias("rule"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .common import shared_dir
    from .warc import archive_round_trip

    pages = table(spark, sf_dir, "pages")
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    out = archive_round_trip(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", captured)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place")


ORACLES["op10_warc"] = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d, regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS u FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first, regexp_replace(u, '^[^/?]*', '') AS t FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(regexp_extract(u, '^([^/?:]*)', 1), '.')), ',') || ')' || CASE WHEN t = '' THEN '/' ELSE t END AS url_key FROM f)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to, url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS place
FROM k
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH x AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM x),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM l p, l q, l r, l s, l t
  WHERE p.l <> q.l AND r.l NOT IN (p.l, q.l) AND s.l NOT IN (p.l, q.l, r.l) AND t.l NOT IN (p.l, q.l, r.l, s.l)),
u AS (SELECT o.filter_order, i::INT AS step, filter_order[i] AS k FROM o, range(1, 6) r(i)),
z AS (
  SELECT m.*, filter_order, step, k, (CASE k WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails,
    least(CASE WHEN a THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN instr(filter_order, 'B') ELSE 6 END, CASE WHEN c THEN instr(filter_order, 'C') ELSE 6 END,
      CASE WHEN d THEN instr(filter_order, 'D') ELSE 6 END, CASE WHEN e THEN instr(filter_order, 'E') ELSE 6 END) AS falls FROM m, u),
y AS (
  SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (falls > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (falls = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND falls < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (falls = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (falls = step), 0)::BIGINT AS toxic_lost FROM z GROUP BY ALL)
SELECT * EXCLUDE (k), sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM y
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def _repair_sql() -> str:
    """The same in SQL: the cheapest, then audit-least way to each of the four states, row by row."""

    def after(state: str, cost: str, letter: str, item: str | None = None) -> str:
        lines = f"list_append({state}.t, {item})" if item else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}}"

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    never = "{'c': 1000000000, 'a': '~', 't': ['']}"
    to_user = [after(s, "5", "I", "'user:'") for s in ("s", "y", "a")]
    user = best("u", *to_user)
    assistant = best("a", after("u2", "5", "I", "'assistant:'"))
    stay = {s: after(s, "2", "D") for s in ("s", "y", "u2", "a2")}

    def new(before: list[str], initial: str, name: str) -> list[str]:
        kept = [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {after(b, 'late', 'K', 'line')} ELSE {never} END" for b in before]
        moved = [f"CASE WHEN NOT gone THEN {after(b, '1 + late', 'R', f"'{name}:' || text")} ELSE {never} END" for b in before] if name else []
        return kept + moved

    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(k) * 8), lambda i: (ascii(k[i // 8 + 1]) >> (i % 8)::INT)::BIGINT & 1)),
    lambda s, b: xor(s >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS fate FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM z, range(1, CASE fate WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END)),
g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT g, d.*, left(role, 1) AS initial, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id),
f AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
    right(rtrim(text, E' \\t\\n\\x0b\\f\\r'), 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY g ORDER BY i) AS last FROM o),
r AS (SELECT g, i, initial, text, role || ':' || text AS line, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS late FROM f),
w AS (
  SELECT g, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s, {{'c': 1000000000::BIGINT, 'a': '~', 't': []::VARCHAR[]}} AS y, {{'c': 1000000000::BIGINT, 'a': '~', 't': []::VARCHAR[]}} AS u,
    {{'c': 1000000000::BIGINT, 'a': '~', 't': []::VARCHAR[]}} AS a FROM g
  UNION ALL
  SELECT g, n + 1, {stay["s"]}, {best(stay["y"], *new(["s"], "s", ""))}, {best(stay["u2"], *new(["s", "y", "a2"], "u", "user"))}, {best(stay["a2"], *new(["u2"], "a", "assistant"))}
  FROM (SELECT *, {assistant} AS a2 FROM (SELECT w.*, {user} AS u2, initial, text, line, gone, late FROM w JOIN r ON r.g = w.g AND r.i = w.n + 1))),
e AS (SELECT g, {best("s", "a2")} AS e FROM (SELECT *, {assistant} AS a2 FROM (SELECT *, {user} AS u2 FROM w QUALIFY n = max(n) OVER (PARTITION BY g)))),
c AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.e.c AS cost, e.e.a AS audit, sha256(array_to_string(e.e.t, chr(10))) AS repaired_sha256
FROM g JOIN e USING (g) LEFT JOIN c USING (g)
"""


ORACLES["op12_conversation_repair"] = _repair_sql()


SHARDS = 8


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=SHARDS).withColumnRenamed("id", "doc_id")


def _sharding_sql() -> str:
    """The same in SQL, over a list of all ends of groups."""
    floor = lambda x: f"coalesce(list_max(list_filter(p, lambda e: e <= {x})), 0)"
    ceil = lambda x: f"(CASE WHEN {x} <= 0 THEN 0 ELSE list_min(list_filter(p, lambda e: e >= {x})) END)"
    greedy = "SELECT *, (lo + hi) // 2 AS mid, 0::BIGINT AS a0 FROM b WHERE lo < hi"
    for k in range(SHARDS):
        greedy = f"SELECT *, {floor(f'a{k} + mid')} AS a{k + 1} FROM ({greedy})"
    back = f"SELECT *, total AS r{SHARDS}, 0::BIGINT AS k0 FROM b WHERE lo = hi"
    for k in range(SHARDS - 1, 0, -1):
        back = f"SELECT *, {ceil(f'r{k + 1} - lo')} AS r{k} FROM ({back})"
    for k in range(1, SHARDS):
        back = f"SELECT *, k{k - 1} + (total - k{k - 1} + {SHARDS - k}) // {SHARDS - k + 1} AS share{k} FROM ({back})"
        back = f"SELECT *, {floor(f'share{k}')} AS below{k}, {ceil(f'share{k}')} AS above{k} FROM ({back})"
        near = f"CASE WHEN below{k} > k{k - 1} AND share{k} - below{k} <= above{k} - share{k} THEN below{k} ELSE above{k} END"
        back = f"SELECT *, least(greatest({near}, r{k}), {floor(f'k{k - 1} + lo')}) AS k{k} FROM ({back})"
    return rf"""
WITH RECURSIVE v AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS v),
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS digest FROM documents),
y AS (SELECT digest, t, list_transform(regexp_extract_all(t, '(?s).'), lambda x: unicode(x)::BIGINT) AS u FROM (SELECT digest, any_value(t) AS t FROM d GROUP BY 1)),
z AS (SELECT digest, flatten(list_transform(u, lambda u: CASE WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 + (u >> 6), 128 + (u & 63)] WHEN u < 65536 THEN [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)]
  ELSE [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63), 128 + (u & 63)] END)) AS bytes FROM y),
c AS (SELECT digest, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM z, v),
g AS (SELECT digest, sum(size)::BIGINT AS bytes FROM d GROUP BY 1),
h AS (SELECT *, CASE WHEN bytes * 65536 >= sum(bytes) OVER () THEN -bytes ELSE 0 END AS ahead FROM g),
e AS (SELECT *, (sum(bytes) OVER (ORDER BY ahead, digest))::BIGINT AS upto FROM h),
b AS (
  SELECT greatest((total + {SHARDS - 1}) // {SHARDS}, largest) AS lo, greatest((total + {SHARDS - 1}) // {SHARDS}, largest) + largest AS hi, total, p
  FROM (SELECT sum(bytes)::BIGINT AS total, max(bytes) AS largest, list(upto ORDER BY upto) AS p FROM e)
  UNION ALL
  SELECT CASE WHEN a{SHARDS} = total THEN lo ELSE mid + 1 END, CASE WHEN a{SHARDS} = total THEN mid ELSE hi END, total, p FROM ({greedy})),
k AS (SELECT [{", ".join(f"k{k}" for k in range(1, SHARDS))}] AS cuts FROM ({back})),
s AS (SELECT digest, ahead, len(list_filter(cuts, lambda x: x < upto))::INT AS shard FROM e, k)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ahead, digest, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN s USING (digest) JOIN c USING (digest)
"""


ORACLES["op13_sharding"] = _sharding_sql()
