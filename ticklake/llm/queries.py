"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import QUERIES, SQL, query, table
from .chat import borrowed_pairs, preferences
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .lexical import ranked
from .merkle import leaf, manifest
from .near_dedup import near_duplicates
from .packing import packed_documents
from .quality import quality_scores
from .sharding import curve_tables, described, sharded
from .simhash import near_prints
from .token_counts import token_counts
from .toxicity import severities
from .url_filters import judged

__all__ = ["QUERIES", "SQL"]

# words as in the contract of op9; A-Z alone are lower-cased
_NEAR_SQL = """
WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
 HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query("op9_minhash", _NEAR_SQL)
def op9(spark, sf_dir):
    """Near-duplicate components over 4-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


_EXACT_SQL = """SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


@query("op7_exact_dedup", _EXACT_SQL)
def op7(spark, sf_dir):
    """Exact duplicates of whole texts up to white space."""
    _, verdicts = exact_duplicates(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op1_packing")
def op1(spark, sf_dir):
    """All documents as sequences of at most 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark, sf_dir):
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2(spark, sf_dir):
    """Benchmark items found in the documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    """Expected severity of all documents."""
    return severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CHAT_SQL = """
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS a FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, a, list_max([i for i in range(1, len(a) + 1) if a[i].role = 'assistant']) AS last FROM c),
o AS (SELECT xor(conv_id, 1) AS conv_id, coalesce(a[last].text, '') AS other FROM l WHERE last IS NOT NULL),
p AS (SELECT conv_id, last IS NOT NULL AS whole, a[:coalesce(last, len(a))] AS ch,
 CASE WHEN last IS NOT NULL THEN list_append(a[:last - 1], {'role': 'assistant', 'text': coalesce(other, '')}) ELSE [] END AS rj FROM l LEFT JOIN o USING (conv_id)),
d AS (SELECT *, coalesce(list_min([i for i in range(1, least(len(ch), len(rj)) + 1) if ch[i] IS DISTINCT FROM rj[i]]) - 1, least(len(ch), len(rj))) AS lcp FROM p),
n AS (SELECT *, CASE WHEN whole THEN greatest(least(lcp, least(len(ch), len(rj)) - 1), 0) ELSE len(ch) END AS n FROM d),
r AS (SELECT conv_id, whole, n, lcp, len(ch) AS k, ch[:n] AS pr, CASE WHEN whole THEN ch[n + 1:] ELSE [] END AS cc, CASE WHEN whole THEN rj[n + 1:] ELSE [] END AS rr FROM n),
s AS (SELECT *, [[length('<|' || coalesce(t.role, '') || '|>' || chr(10)), length(replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>'), CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END] for t in cc] AS cl,
 [[length('<|' || coalesce(t.role, '') || '|>' || chr(10)), length(replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>'), CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END] for t in rr] AS rl FROM r),
m AS (SELECT *, [coalesce(list_sum([z[1] + z[2] + 1 for z in cl[:i - 1]]), 0) + cl[i][1] for i in range(1, len(cl) + 1)] AS cs,
 [coalesce(list_sum([z[1] + z[2] + 1 for z in rl[:i - 1]]), 0) + rl[i][1] for i in range(1, len(rl) + 1)] AS rs FROM s)
SELECT conv_id, CASE WHEN NOT whole THEN 'incomplete' WHEN lcp = k THEN 'identical' ELSE 'pair' END AS status, n AS n_prompt,
 array_to_string(['<|' || coalesce(t.role, '') || '|>' || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10) for t in pr], '') AS prompt,
 array_to_string(['<|' || coalesce(t.role, '') || '|>' || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10) for t in cc], '') AS chosen_text,
 array_to_string([CAST(cs[i] AS BIGINT) || '-' || CAST(cs[i] + cl[i][2] AS BIGINT) for i in range(1, len(cl) + 1) if cl[i][3] = 1], ',') AS chosen_mask,
 array_to_string(['<|' || coalesce(t.role, '') || '|>' || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10) for t in rr], '') AS rejected_text,
 array_to_string([CAST(rs[i] AS BIGINT) || '-' || CAST(rs[i] + rl[i][2] AS BIGINT) for i in range(1, len(rl) + 1) if rl[i][3] = 1], ',') AS rejected_mask
FROM m"""


@query("op5_preferences", _CHAT_SQL)
def op5(spark, sf_dir):
    """Preference rows of all conversations."""
    return preferences(borrowed_pairs(table(spark, sf_dir, "conversations")))


_URL_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS x FROM pages),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS t FROM u WHERE url IS NOT NULL),
e0 AS (SELECT url AS a, replace(CASE WHEN regexp_matches(t, '(?i)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>;]*://[^"''\s>]*)', 1)
 WHEN regexp_matches(t, '(?i)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]*://[^"''\s>]*)', 1) END, '&amp;', '&') AS b FROM tag),
e AS (SELECT a, b FROM e0 WHERE b <> '' AND a <> b UNION SELECT b, a FROM e0 WHERE b <> '' AND a <> b),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
node AS (SELECT url FROM u WHERE url IS NOT NULL UNION SELECT b FROM e),
np AS (SELECT url, coalesce(translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') AS path
 FROM (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS x FROM node)),
own AS (SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM np JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
hit AS (SELECT DISTINCT r.a AS url FROM reach r JOIN own ON own.url = r.b AND own.verdict = 'block')
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN np ON np.url = u.url LEFT JOIN own ON own.url = u.url LEFT JOIN hit ON hit.url = u.url"""


@query("op6_url_filters", _URL_SQL)
def op6(spark, sf_dir):
    """Verdicts on all pages."""
    return judged(table(spark, sf_dir, "pages")).drop("component")


@query("op8_quality")
def op8(spark, sf_dir):
    """Quality scores of all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# CRC-32 by its table: ``t`` has it as ``tab``
_CRC_TABLE = "t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def _crc_sql(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode(coalesce({text}, ''))), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"


def _shard_sql() -> str:
    """CRC-32 by its table, the curve by its tables, then ranks."""
    digit, follow = (str([x for row in t for x in row]) for t in curve_tables(3))

    return f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc_sql("text")} AS text_crc32, CASE WHEN lang IS NULL THEN 0 ELSE {_crc_sql("lang")} % 16 END AS x, CASE WHEN source IS NULL THEN 0 ELSE {_crc_sql("source")} % 16 END AS y FROM documents, t),
z AS (SELECT *, least(greatest(length(bin(size)) - 5, 0), 15) AS z FROM d),
c AS (SELECT doc_id, size, text_crc32, list_reduce(list_prepend(0::BIGINT, [3, 2, 1, 0]), lambda a, k: ((a // 16) * 8 + {digit}[(a % 16) * 8 + ((x >> k) & 1) * 4 + ((y >> k) & 1) * 2 + ((z >> k) & 1) + 1]) * 16 + {follow}[(a % 16) * 8 + ((x >> k) & 1) * 4 + ((y >> k) & 1) * 2 + ((z >> k) & 1) + 1]) // 16 AS curve FROM z),
r AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id) - 1 AS k, count(*) OVER () AS n FROM c)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k * 24 // n AS INTEGER) AS shard, k - ((k * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS DOUBLE) AS grown_shard, curve FROM r"""


@query("op10_hilbert", _shard_sql())
def op10(spark, sf_dir):
    """Shards of all documents, along the curve; counts at most one apart."""
    rows = sharded(described(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


_RANK_SQL = """
WITH x AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM x WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t),
c AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS c FROM p JOIN v USING (t), s),
e AS (SELECT item_id, r, doc_id, sum(c)::BIGINT AS score FROM q JOIN c USING (t) GROUP BY ALL HAVING sum(c) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM e QUALIFY rank <= 50"""


@query("op11_ranked_search", _RANK_SQL)
def op11(spark, sf_dir):
    """The 50 best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_simhash")
def op12(spark, sf_dir):
    """SimHash components over 3-word shingles, at most 3 bits apart."""
    return near_prints(table(spark, sf_dir, "documents"), words=3, distance=3)


def _merkle_sql(levels: int = 5) -> str:
    """The tree level by level, up to ``16 ** levels`` leaves a source and as many sources."""

    def hashed(text: str) -> str:
        fields = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        _CRC_TABLE,
        f"d AS (SELECT row_number() OVER () AS r, doc_id, source AS s, {hashed('text')} AS leaf, CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 5 = 0 THEN {hashed(low)} ELSE {hashed('text')} END AS bad FROM documents, t)",
        "a0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY s) AS n, r FROM d)",
    ]

    def grow(x: str, key: str) -> None:
        for k in range(levels):
            on = f"SELECT {key}, CASE WHEN n > 1 THEN i // 16 ELSE i END AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY z)) ELSE any_value(h) END AS h, CASE WHEN any_value(n) > 1 THEN (any_value(n) + 15) // 16 ELSE 1 END AS n"
            ctes.append(f"{x}{k + 1} AS ({on} FROM (SELECT {key}, i, i AS z, h, n FROM {x}{k}) GROUP BY {key}, CASE WHEN n > 1 THEN i // 16 ELSE i END)")

    grow("a", "s")
    ctes.append(f"b0 AS (SELECT 1 AS g, s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM a{levels})")
    grow("b", "g")
    # the witness of a leaf, folded level by level: text so far, and what the changed leaf comes to
    ctes.append("f0 AS (SELECT d.r, d.doc_id, d.leaf, d.s, a0.i, d.bad AS f, '' AS w FROM d JOIN a0 USING (r))")
    step = 0
    for x, on in (("a", "f.s IS NOT DISTINCT FROM {t}.s"), ("b", "TRUE")):
        if x == "b":
            ctes.append(f"f{step + 1} AS (SELECT f.r, f.doc_id, f.leaf, f.s, b0.i, f.f, f.w FROM f{step} f JOIN b0 ON f.s IS NOT DISTINCT FROM b0.s)")
            step += 1
        for k in range(levels):
            t = f"{x}{k}"
            ctes.append(
                f"g{step} AS (SELECT f.r, any_value({t}.n) AS n, coalesce(string_agg({t}.h, '' ORDER BY {t}.i) FILTER ({t}.i < f.i), '') AS pre, coalesce(string_agg({t}.h, '' ORDER BY {t}.i) FILTER ({t}.i > f.i), '') AS post "
                f"FROM f{step} f JOIN {t} ON {on.format(t=t)} AND {t}.i // 16 = f.i // 16 GROUP BY f.r)"
            )
            ctes.append(f"f{step + 1} AS (SELECT f.r, f.doc_id, f.leaf, f.s, CASE WHEN g.n > 1 THEN f.i // 16 ELSE f.i END AS i, CASE WHEN g.n > 1 THEN sha256(g.pre || f.f || g.post) ELSE f.f END AS f, f.w || g.pre || g.post AS w FROM f{step} f JOIN g{step} g USING (r))")
            step += 1
    return f"""WITH {", ".join(ctes)}
SELECT f.doc_id, f.leaf, b0.h AS subroot, b.h AS root, sha256(f.w) AS proof_sha256, f.f AS folded_root, f.f = b.h AS verified
FROM f{step} f JOIN b0 ON f.s IS NOT DISTINCT FROM b0.s, b{levels} b"""


@query("op13_merkle", _merkle_sql())
def op13(spark, sf_dir):
    """Manifest of all documents; in every fifth row by checksum of its id the text's capitals are lowered before it is checked."""
    id_ = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(table(spark, sf_dir, "documents"), tampered=F.when(id_ % 5 == 0, leaf({"text": low})))
