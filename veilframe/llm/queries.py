"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.importance import resample
from veilframe.llm.language_id import identify, train
from veilframe.llm.license_scan import scan_licenses
from veilframe.llm.license_texts import ALL_TEMPLATES, TERMS
from veilframe.llm.lm_score import score_documents
from veilframe.llm.mixing import mix_sources
from veilframe.llm.near_dedup import near_duplicates
from veilframe.llm.nearest import build_index, search
from veilframe.llm.periodic import periodic_runs
from veilframe.llm.personal import BASE_KINDS, personal_data
from veilframe.llm.pieces import encode_texts
from veilframe.llm.quality import judge_quality, learn_ratio
from veilframe.llm.shared import shared_path
from veilframe.llm.url_filter import judge_urls, make_rules
from veilframe.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- 1: WARC


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = r"^<urn:x-page:(.+)>$"
    return read_warc(spark, path, with_payload=False).select(
        F.regexp_extract("record_id", page, 1).try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.regexp_extract("refers_to", page, 1).try_cast("bigint").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') html, strlen(coalesce(html, '')) n FROM pages),
     h AS (SELECT html, max(page_id) hub FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN hub <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN hub <> page_id THEN hub END AS refers_to
FROM p LEFT JOIN h ON p.html = h.html
"""


# ---------------------------------------------------------------- 2: LM scoring


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 3: mixing

#: Target shares: the dominant source is held down, four good ones are repeated, and
#: all others share the rest.
MIX_WEIGHTS = {"src0": 0.16, "src1": 0.10, "src2": 0.08, "src3": 0.08, "src4": 0.06}
MIX_OTHER = 0.52
MIX_SEED = 20


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_OTHER, seed=MIX_SEED)


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT unnest([{', '.join(f"'{s}'" for s in MIX_WEIGHTS)}]) grp, unnest([{', '.join(f'{x}::DOUBLE' for x in MIX_WEIGHTS.values())}]) weight
                     UNION ALL SELECT NULL, {MIX_OTHER}::DOUBLE),
 d AS (SELECT d.*, w.grp FROM documents d LEFT JOIN w ON d.source = w.grp),
 n AS (SELECT grp, count(*) n FROM d GROUP BY grp),
 r AS (SELECT n.grp, weight / (sum(weight) OVER ()) * (sum(n) OVER ()) / n AS rate FROM n JOIN w ON n.grp IS NOT DISTINCT FROM w.grp),
 m AS (SELECT grp, greatest(1, ceil(rate / 16))::INT parts, rate / greatest(1, ceil(rate / 16)) mean FROM r),
 c AS (SELECT grp, mean, 0 k, exp(-mean) p, exp(-mean) cdf FROM m
       UNION ALL SELECT grp, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < 80),
 u AS (SELECT doc_id, grp, unnest(range(1, parts + 1)) part FROM d JOIN m USING (grp) WHERE grp IS NOT NULL
       UNION ALL SELECT doc_id, d.grp, unnest(range(1, parts + 1)) FROM d, m WHERE d.grp IS NULL AND m.grp IS NULL),
 x AS (SELECT u.doc_id, count(*) copies FROM u JOIN c ON u.grp IS NOT DISTINCT FROM c.grp
         AND cdf < (('0x' || substr(md5('{MIX_SEED}:' || part || ':' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE
       GROUP BY u.doc_id)
SELECT doc_id, text, lang, source, n_chars, copy, substr(md5('{MIX_SEED} order:' || copy || ':' || doc_id), 1, 16) mix_key
FROM (SELECT documents.*, unnest(range(1, copies + 1)) AS copy FROM documents JOIN x USING (doc_id))
"""


# ---------------------------------------------------------------- 4: quality rules


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = learn_ratio(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, ratio).drop("text")


# ---------------------------------------------------------------- 5: license scans


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), ALL_TEMPLATES, terms=TERMS)


# ---------------------------------------------------------------- 6: language ID


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, ~held_out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# ---------------------------------------------------------------- 7: SentencePiece


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model()).drop("text")


# ---------------------------------------------------------------- 8: near duplicates


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


# ---------------------------------------------------------------- 9: nearest neighbours


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors, k=20), vectors.where("vec_id % 20 = 0"), k=20)


# ---------------------------------------------------------------- 10: URL filters

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, make_rules(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH rules AS (SELECT unnest([{', '.join(f"'{r[0]}'" for r in URL_RULES)}]) rhost, unnest([{', '.join(f"'{r[1]}'" for r in URL_RULES)}]) rpath,
                      unnest([{', '.join(f"'{r[2]}'" for r in URL_RULES)}]) rverdict),
 p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
 q AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*', 0)) host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM p),
 f AS (SELECT *, row_number() OVER () AS row_no FROM q),
 m AS (SELECT row_no, arg_max(rhost || rpath, length(rhost || rpath)) best, arg_max(rverdict, length(rhost || rpath)) verdict FROM f JOIN rules
       ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_no)
SELECT page_id, host, path, best AS rule, coalesce(verdict, 'allow') AS verdict FROM f LEFT JOIN m USING (row_no)
"""


# ---------------------------------------------------------------- 11: importance resampling


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _half_byte(n: int) -> int:
    """The CRC-32 register after half a byte."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_HALVES = "list_transform(range(2 * strlen(f)), lambda i: ('0x' || substr(h, i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END, 1))::BIGINT)"
_CRC = (
    f"xor(list_reduce({_HALVES}, lambda crc, half: xor(crc >> 4, ({[_half_byte(n) for n in range(16)]}::BIGINT[])[(xor(crc, half) & 15) + 1]), "
    "4294967295::BIGINT), 4294967295)"
)


def _features_sql(table_name: str, row: str) -> str:
    """``row, f, n``: the features of texts and how often each comes."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    windows = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    return (
        f"(SELECT row, f, count(*) AS n FROM (SELECT row, unnest({windows}) AS f FROM "
        f"(SELECT {row} AS row, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_name})) GROUP BY row, f)"
    )


# A feature's checksum is worked out once, half a byte at a time.
OP11_SQL = f"""
WITH d AS MATERIALIZED {_features_sql('documents', 'doc_id')}, b AS MATERIALIZED {_features_sql('benchmark', 'item_id')},
c AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM b))),
s AS (SELECT bucket, sum(n) AS s FROM d JOIN c USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM b JOIN c USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE /
  ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
v AS (SELECT row AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight, sum(CASE WHEN f NOT LIKE '% %' THEN n END) AS words
  FROM d JOIN c USING (f) JOIN g USING (bucket) GROUP BY row),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(words, 0) AS words,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""


# ---------------------------------------------------------------- 12: periodic runs


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where about a tenth of the texts repeats a stretch of its own words
    up to its end; which one, from where and how often is given by the id's CRC-32."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.expr("crc32(cast(doc_id as string)) div 10").alias("g"))
    n = F.size("words")
    a = F.expr("cast(g % size(words) as int)")
    p = F.expr("cast(1 + (size(words) - g % size(words)) div (3 + g % 8) as int)")
    moved = cut.select("*", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    source = F.transform(F.expr("sequence(0, size(words) - 1)"), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return moved.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return found.select("doc_id", "runs", listed.alias("listed"), "collapsed", longest.alias("longest")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.col2")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.col3")).alias("period"),
        F.expr("1000 * longest.length div -longest.col3").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc_sql(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte))"
    codes = f"list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda crc, byte: {bits}, 4294967295::BIGINT), 4294967295)"


# Equal words one period apart, put together to stretches.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS old, {_crc_sql('doc_id::VARCHAR')} AS h FROM documents),
e AS (SELECT *, CASE WHEN h % 10 = 0 THEN (h // 10) % len(old) END AS a, 1 + (len(old) - (h // 10) % len(old)) // (3 + (h // 10) % 8) AS p FROM d),
w AS (SELECT doc_id, unnest(range(len(old))) AS i, unnest(list_transform(range(len(old)), lambda i: old[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])) AS word, len(old) AS n FROM e),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, m + q AS l, q FROM (SELECT doc_id, s, m, q, m + q AS l FROM islands) WHERE m + q >= greatest(12, 2 * q) QUALIFY row_number() OVER (PARTITION BY doc_id, s, l ORDER BY q) = 1),
best AS (SELECT doc_id, count(*) AS n_runs, arg_max([s, l, q], [l, -s, -q]) AS r, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r[1] AS start, r[2] AS length, r[3] AS period, 1000 * r[2] // r[3] AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN texts USING (doc_id)
"""


# ---------------------------------------------------------------- 13: personal data


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
