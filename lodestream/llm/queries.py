"""The thin ``opN_<name>`` queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; the operators themselves take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.counted(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audio

    return audio.features(written(audio.media_column(table(spark, sf_dir, "documents")), "media", level=9))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    limit = token_counts.LIMIT
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), budgets=(limit,))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("fits")[limit].alias("fitting_chars"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.summary(table(spark, sf_dir, "documents"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_knn

    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dropout

    return dropout.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False, check=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    scored = quality_rules.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.with_crc(packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of ``op1_pii``: the base kinds."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of ``op9_quality_rules``: the base statistics and verdict."""
    return op9_quality_rules(spark, sf_dir).drop("kept", "quality")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {"pii_base": pii_base, "quality_base": quality_base}


#: The contract's patterns by kind (fixed values), and what a match must pass.
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0"),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        """len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i:
            CASE WHEN i % 2 = 1 THEN CAST(d[len(d) - i + 1] AS INT) ELSE (CAST(d[len(d) - i + 1] AS INT) * 2) % 10 + CAST(d[len(d) - i + 1] AS INT) // 5 END)) % 10 = 0""",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 9 AND 15"),
}


def _sql_spans() -> str:
    """``doc_id, kind, k, start`` and ``stop`` of every base span: gaps and matches of a text alternate, so their lengths give the places."""
    found = [
        f"""SELECT row_id, {k} AS k, '{kind}' AS kind, i, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
                   list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: len(x))), 0) AS start
            FROM (SELECT row_id, regexp_extract_all(text, '{pattern}') AS matches, string_split_regex(text, '{pattern}') AS gaps FROM own), unnest(matches) WITH ORDINALITY AS t(m, i)"""
        for k, (kind, (pattern, _)) in enumerate(_SQL_KINDS.items())
    ]
    passes = " ".join(f"WHEN kind = '{kind}' THEN {test}" for kind, (_, test) in _SQL_KINDS.items())
    return f"SELECT row_id, k, kind, start, start + len(m) AS stop FROM ({' UNION ALL '.join(found)}) WHERE CASE {passes} END"


#: Where SQL can express a query.  The others depend on a tokenizer, a fingerprint hash, a media format or a fitted model, or on scores of
#: context; tests hold those against brute-force versions.
ORACLES = {
    "pii_base": f"""
        WITH own AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents), spans AS ({_sql_spans()})
        SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _SQL_KINDS)},
               sha256(coalesce(string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY k, start), '')) AS base_sha256
        FROM own LEFT JOIN spans USING (row_id) GROUP BY row_id, doc_id
    """,
    "quality_base": r"""
        WITH split AS (
            SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
        ), windows AS (
            SELECT row_id, i, words[i:i + 4] AS w, count(*) OVER (PARTITION BY row_id, words[i:i + 4]) AS n
            FROM split, unnest(range(1, len(words) - 3)) AS t(i)
        ), repeated AS (
            SELECT row_id, count(DISTINCT i + k) AS n FROM windows, unnest(range(0, 5)) AS t(k) WHERE n > 1 GROUP BY row_id
        ), counted AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: len(w))), 0) AS BIGINT) AS word_chars,
                   CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
            FROM split LEFT JOIN repeated USING (row_id)
        )
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
    """,
    "op4_warc": """
        WITH digested AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT payload_digest, min(page_id) AS first_page FROM digested WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_page < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_page < page_id THEN first_page END AS refers_to
        FROM digested LEFT JOIN firsts USING (payload_digest)
    """,
    "op5_substrings": r"""
        WITH split AS (
            SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT row_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS digest
            FROM split, unnest(range(1, len(words) - 33)) AS t(i)
        ), repeated AS (
            SELECT digest FROM windows GROUP BY digest HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT row_id, i + k AS place FROM windows JOIN repeated USING (digest), unnest(range(0, 35)) AS t(k)
        ), each_word AS (
            SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
        ), kept AS (
            SELECT row_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
            FROM each_word ANTI JOIN gone USING (row_id, place) GROUP BY row_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (row_id)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
