"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provena.llm.support import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.pivot_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


#: Row numbers tell rows apart that repeat an id.
OP1_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), part AS (
  SELECT r, vec_id, unnest(v) AS x, unnest(range(len(v))) AS at FROM usable
), scored AS (
  SELECT q.r AS own, q.vec_id AS query_id, p.r, p.vec_id, CAST(sum(q.x * p.x) AS BIGINT) AS score
  FROM part q JOIN part p ON q.at = p.at AND q.r <> p.r
  WHERE q.vec_id % 20 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.winnow import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sizes AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), spots AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), met AS (SELECT r, item, n, i FROM spots JOIN windows USING (n, x)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.chosen_path import join

    return join(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), opened AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.r AS a, b.r AS b FROM opened a JOIN opened b ON a.t = b.t AND a.r <> b.r
  GROUP BY a.r, b.r HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
classes AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = b GROUP BY a),
links AS (SELECT a AS r, count(*) AS n_links FROM pairs GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d JOIN classes USING (r) LEFT JOIN links USING (r)
"""


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.debruijn import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x FROM d, unnest(range(1, len(w) - 48)) AS u(i) WHERE len(w) >= 50),
least AS (SELECT x, min(doc_id) AS low FROM spots GROUP BY x),
marked AS (SELECT DISTINCT r, i FROM spots JOIN least USING (x) WHERE low < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM marked),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT r, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept
  FROM words LEFT JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from provena.llm.token_counts import token_counts

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_counts(_table(spark, sf_dir, "documents"), f.read())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.secrets import report

    return report(_table(spark, sf_dir, "documents"))


_KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "jwt": (r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 24),
}
#: Row numbers keep repeated rows apart; offsets are running sums of the lengths between and of the matches.  A jwt's match also holds what stands before it.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (
""" + "\nUNION ALL\n".join(f"""  SELECT r, {n} AS k, '{kind}' AS kind, unnest(list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x))) AS n,
    unnest(list_transform(regexp_extract_all(text, '{p}', {group}), lambda x: length(x))) AS own,
    unnest(list_transform(regexp_split_to_array(text, '{p}')[:-2], lambda x: length(x))) AS gap,
    unnest(range(len(regexp_extract_all(text, '{p}')))) AS i, {least} AS least
  FROM d WHERE regexp_matches(text, '{p}')""" for n, (kind, (p, group, least)) in enumerate(_KINDS.items())) + """
), found AS (
  SELECT r, k, kind, own >= least AS kept, CAST(sum(gap + n) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS stop, CASE WHEN kind = 'jwt' THEN own ELSE n END AS n FROM pieces
), listed AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, k) AS spans
  FROM found WHERE kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)
"""


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.lattice import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lows AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 5 * length(d.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN low < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN lows ON lows.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id
), p AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, i AS step, o[i] AS f, left(o, i - 1) AS before FROM orders, unnest(range(1, 6)) AS u(i)),
x AS (SELECT part, o, step, f, n, good, toxic, fails = f AS alone, contains(fails, f) AS bad, length(translate(fails, before, '')) < length(fails) AS gone FROM p, steps),
s AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, f,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND bad), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND bad AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND bad AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, o, step, f
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM s
"""


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.bwt import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


#: Texts as hexadecimal, two characters a byte.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
spots AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS x FROM d, unnest(range(0, n - 199)) AS u(i) WHERE n >= 200),
often AS (SELECT x FROM spots GROUP BY x HAVING count(*) > 1),
marked AS (SELECT r, i FROM spots JOIN often USING (x)),
runs AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k
  FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000000) AS before FROM marked)),
cuts AS (SELECT r, k, min(i) AS lo, max(i) + 200 AS hi FROM runs GROUP BY r, k),
edges AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prior, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS next FROM cuts),
kept AS (
  SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * prior + 1, 2 * (lo - prior)) || CASE WHEN next IS NULL THEN substr(h, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS rest
  FROM edges JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.turns import damage_and_repair

    return damage_and_repair(_table(spark, sf_dir, "conversations"))


_CRC = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, octet_length(encode({0}))), lambda k: CAST(ord(chr(CAST(concat('0x', substr(hex(encode({0})), 2 * k + 1, 2)) AS INTEGER))) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x // 2, 3988292384 * (x % 2))))"""


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _op12_step() -> str:
    """One row of the recursion: the states after it.  A state is a struct (c, a): cost and audit."""
    then = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'a': {x}.a || {letter}}}"
    user = _least("f.u", then("f.n", 5, "'I'"), then("f.s", 5, "'I'"), then("f.a", 5, "'I'"))
    cost = "CASE WHEN r.fault = 3 THEN 5 ELSE 0 END"
    return f"""
  SELECT f.conv_id, f.pos + 1 AS pos, n, s, u, a FROM (
    SELECT e.conv_id, e.pos, {then("e.n", 2, "'D'")} AS n,
      CASE WHEN r.fault IN (1, 2) OR r.initial <> 's' THEN {then("e.s", 2, "'D'")} ELSE {_least(then("e.s", 2, "'D'"), then("e.n", cost, "'K'"))} END AS s,
      CASE WHEN r.fault IN (1, 2) THEN {then("e.u", 2, "'D'")} ELSE {_least(then("e.u", 2, "'D'"), then("e.pu", f"{cost} + CASE WHEN r.initial = 'u' THEN 0 ELSE 1 END", "CASE WHEN r.initial = 'u' THEN 'K' ELSE 'R' END"))} END AS u,
      CASE WHEN r.fault IN (1, 2) THEN {then("e.a", 2, "'D'")} ELSE {_least(then("e.a", 2, "'D'"), then("e.iu", f"{cost} + CASE WHEN r.initial = 'a' THEN 0 ELSE 1 END", "CASE WHEN r.initial = 'a' THEN 'K' ELSE 'R' END"))} END AS a
    FROM (SELECT *, {_least("n", "s", "ia")} AS pu FROM (SELECT *, {_least("a", then("iu", 5, "'I'"))} AS ia FROM (SELECT f.*, {user} AS iu FROM f))) e
    JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos + 1
  ) f"""


OP12_SQL = f"""
WITH RECURSIVE before AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor({_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}, 4294967295) % 20 AS kind FROM conversations
), after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM before, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE kind <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM after),
told AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed
), flagged AS (
  SELECT *, CASE WHEN tail = '' THEN 1 WHEN again THEN 2 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM told
), f(conv_id, pos, n, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': CAST(1e15 AS BIGINT), 'a': ''}}, {{'c': CAST(1e15 AS BIGINT), 'a': ''}}, {{'c': CAST(1e15 AS BIGINT), 'a': ''}}
  FROM (SELECT DISTINCT conv_id FROM flagged)
  UNION ALL {_op12_step()}
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM flagged GROUP BY conv_id
), best AS (
  SELECT c.*, list_min([f.n, f.a, {{'c': f.u.c + 5, 'a': f.u.a || 'I'}}, {{'c': f.s.c + 10, 'a': f.s.a || 'II'}}]) AS best
  FROM counted c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.pos = c.n
), letters AS (
  SELECT conv_id, i, substr(best.a, i, 1) AS letter, CASE WHEN substr(best.a, i, 1) = 'I' THEN NULL ELSE length(replace(left(best.a, i), 'I', '')) END AS pos
  FROM best, unnest(range(1, length(best.a) + 1)) AS v(i)
), kept AS (
  SELECT l.conv_id, l.i, l.letter, r.initial, r.role, coalesce(r.text, '') AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) AS k,
    first_value(CASE WHEN l.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY l.i) AS system
  FROM letters l LEFT JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.pos = l.pos WHERE l.letter <> 'D'
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.best.c, 0) AS cost, coalesce(b.best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from provena.llm.bpe import round_trip

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        return round_trip(_table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.langid import identify, learn

    docs = _table(spark, sf_dir, "documents")
    model = learn(docs.where(remainder(5) != 0))
    return identify(docs, model, (remainder(5) == 0).alias("held_out"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.ctw import score

    return score(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.convnet import classify, learn

    docs = _table(spark, sf_dir, "documents")
    network = learn(docs, _table(spark, sf_dir, "labels"))
    return classify(docs, network, (remainder(5) == 0).alias("held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": OP1_SQL, "op4_secrets": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_jaccard": OP7_SQL, "op8_substrings": OP8_SQL, "op11_suffixes": OP11_SQL, "op12_turns": OP12_SQL, "op13_lattice": OP13_SQL}
