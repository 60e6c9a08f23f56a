"""The registered queries of this subpackage: name -> (spark, folder) -> DataFrame, and the SQL that says the same."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomdoc.llm import archive, decontaminate, jaccard, langid, lattice, linededup, packing, periods, pieces, pseudonyms, quality, ranking, secretscan
from fathomdoc.llm.common import remainder, scan_table
from fathomdoc.session import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op9_content_addressed_archive", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    g AS (SELECT payload, max(page_id) AS owner FROM p GROUP BY payload)
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
      CASE WHEN octet_length(payload) < 1000 OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN octet_length(payload) >= 1000 AND page_id <> owner THEN owner END AS refers_to
    FROM p JOIN g USING (payload)""")
def op9(spark, folder):
    return archive.archive_round_trip(scan_table(spark, folder, "pages")).drop("url")


@query("op10_power_of_two_packing")
def op10(spark, folder):
    return packing.pack(scan_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_subword_language_id")
def op3(spark, folder):
    docs = scan_table(spark, folder, "documents")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op5_subword_lattice_likelihood")
def op5(spark, folder):
    docs = scan_table(spark, folder, "documents")
    return lattice.score_documents(docs, remainder(F.col("doc_id"), 7) != 2, public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_latent_decontamination")
def op2(spark, folder):
    return decontaminate.contaminated(*[scan_table(spark, folder, t) for t in ("documents", "benchmark")])


@query("op8_jaccard_metric_join")
def op8(spark, folder):
    return jaccard.similar_documents(scan_table(spark, folder, "documents"))


QUALITY_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, nullif(lang, '') AS ref, row_number() OVER () AS rid FROM documents),
    r AS (SELECT rid, doc_id, t, ref,
      list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS low,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    f AS (SELECT rid, doc_id, ref, len(words) AS n_words, CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS wc,
      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '[0-9]')) AS digit,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(t) AS chars,
      length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS ascii, length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters,
      length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper FROM r),
    p AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM r),
    g AS (SELECT rid, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS three FROM p
      WINDOW s AS (PARTITION BY rid ORDER BY i)),
    again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS n FROM g WHERE three IS NOT NULL) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
    lw AS (SELECT rid, ref, unnest(low) AS word FROM r WHERE ref IS NOT NULL),
    tot AS (SELECT ref, count(*) AS total FROM lw GROUP BY ref HAVING count(*) >= 1000),
    q AS (SELECT ref, word, count(*) / any_value(total) AS q FROM lw JOIN tot USING (ref) GROUP BY ref, word
      HAVING count(*) >= 0.005 * any_value(total)),
    rest AS (SELECT ref, 1 - coalesce(sum(q), 0) AS q FROM tot LEFT JOIN q USING (ref) GROUP BY ref),
    bins AS (SELECT rid, lw.ref, CASE WHEN q.word IS NULL THEN NULL ELSE lw.word END AS word, count(*) AS c
      FROM lw LEFT JOIN q ON q.ref = lw.ref AND q.word = lw.word GROUP BY ALL),
    pq AS (SELECT rid, c / sum(c) OVER (PARTITION BY rid) AS p, coalesce(q.q, rest.q) AS q FROM bins
      LEFT JOIN q ON q.ref = bins.ref AND q.word = bins.word JOIN rest ON rest.ref = bins.ref),
    wd AS (SELECT rid, sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + greatest(0, 1 - sum(q)) AS twice
      FROM pq GROUP BY rid),
    c AS (SELECT rid, ref, unnest([greatest(ascii - least(upper, ascii), 0), least(upper, ascii), letters - ascii, digit,
      chars - coalesce(wc, 0), n_symbols, chars - letters - digit - (chars - coalesce(wc, 0)) - n_symbols]) AS n, unnest(range(7)) AS k, chars FROM f),
    e AS (SELECT ref, k, sum(n) / sum(chars) AS q FROM c WHERE ref IS NOT NULL GROUP BY ref, k HAVING sum(chars) >= 4000),
    cd AS (SELECT rid, sum(CASE WHEN n > 0 THEN n / chars * log2(2 * n / chars / (n / chars + q)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(2 * q / (n / chars + q)) ELSE 0 END) AS twice FROM c JOIN e USING (ref, k) WHERE chars > 0 GROUP BY rid),
    z AS (SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
      CASE WHEN chars >= 400 AND cd.twice IS NOT NULL THEN round(sqrt(greatest(0, cd.twice / 2)), 6) END AS char_distance,
      CASE WHEN n_words >= 100 AND wd.twice IS NOT NULL THEN round(sqrt(greatest(0, wd.twice / 2)), 6) END AS word_distance
      FROM f LEFT JOIN covered USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(char_distance <= 0.28, true)
        AND coalesce(word_distance <= 0.3, true) AS kept FROM z"""


@query("op1_divergence_quality", QUALITY_SQL)
def op1(spark, folder):
    return quality.quality_rules(scan_table(spark, folder, "documents"))


@query("op7_deletion_neighbourhood_lines")
def op7(spark, folder):
    return linededup.repeated_lines(scan_table(spark, folder, "documents"))


#: The key of a production run comes from the job's settings; this one makes the registered query repeatable.
PSEUDONYM_KEY = "registered-query"


@query("op4_feistel_pseudonyms")
def op4(spark, folder):
    return pseudonyms.pseudonymise(scan_table(spark, folder, "documents"), PSEUDONYM_KEY)


@query("op6_secret_forest")
def op6(spark, folder):
    return secretscan.scan_secrets(scan_table(spark, folder, "documents"))


@query("op13_distinct_chunk_pieces")
def op13(spark, folder):
    encoded = pieces.encode(scan_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text) where, in about a tenth of the rows, the words from some word on are repeated in periods."""
    blank = F.lit(r"[\x20\x09-\x0D]+")
    docs = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    docs = once(docs, words=F.when(chosen, F.filter(F.split("text", blank), lambda w: w != "")))
    docs = docs.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE words[int(a + (i - a) % p)] END), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


@query("op11_recompression_runs")
def op11(spark, folder):
    found = periods.periodic_runs(with_periods(scan_table(spark, folder, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length",
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_hybrid_ranked_search", r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    n AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
    tot AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term),
    m AS (SELECT rid, 100 - 75 + ((75 * n * big_n) // big_l) AS m FROM n, tot),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
    s AS (SELECT item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""")
def op12(spark, folder):
    return ranking.rank_documents(*[scan_table(spark, folder, t) for t in ("documents", "benchmark")])
