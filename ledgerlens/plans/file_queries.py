"""File, text and licence operators over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scalars import LICENSE_PHRASES, STOP_WORDS, comment_words, identifier_words, identify_license, license_matches, word_overlap
from ..operators import files as O
from ..operators import graph as G
from ..operators import security as S
from . import views as V


def language_profile(spark, sf_dir):
    files = V.files(spark, sf_dir)
    files = files.withColumn("sloc", O.line_counts(F.col("content"))[1])
    return O.language_profile(files).select("language", "files", "sloc", F.round("share", 6).alias("share"))


def sloc_per_file(spark, sf_dir):
    lines, sloc = O.line_counts(F.col("content"))
    return V.files(spark, sf_dir).select("path", lines.alias("lines"), sloc.alias("sloc"))


def file_index(spark, sf_dir):
    """The file table's hashes, sizes and flags."""
    indexed = O.index_files(V.files(spark, sf_dir).select("path", "content"))
    return indexed.select("path", "ext", "size_bytes", "lines", "sha1", "is_code", "is_test", "is_generated")


def exact_duplicate_files(spark, sf_dir):
    files = V.files(spark, sf_dir).withColumn("sha1", F.sha1(F.col("content").cast("binary")))
    return O.duplicates(files)


def clone_families_normalised(spark, sf_dir):
    files = V.files(spark, sf_dir).withColumn("shape", O.clone_shape(F.col("content"))).withColumn("weight", F.length("content"))
    return O.clone_families(files).select("members", "first_member", "volume")


def walk_caps(spark, sf_dir):
    files = V.files(spark, sf_dir).withColumn("size_bytes", F.octet_length("content").cast("long"))
    capped = O.walk_caps(files, max_files=40, max_file=12_000, max_total=60_000)
    return capped.select("path", "size_bytes", "status")


def generated_header(spark, sf_dir):
    files = V.files(spark, sf_dir)
    lic = F.substring("content", 1, 1000).rlike("(?i)licensed under")
    return files.select("path", paths.has_generated_header(F.col("content")).alias("generated"), lic.alias("license_header"))


def license_fingerprint(spark, sf_dir):
    return V.files(spark, sf_dir).select("path", identify_license(F.col("content")).alias("license"))


DECLARED = ("MIT", "(MIT OR Apache-2.0)", "BSD", "GPL-3.0-only", "")


def license_matches_declared(spark, sf_dir):
    """Parts that declare one licence and hold the text of another."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    rows = V.read(spark, sf_dir, "part").select(pick(DECLARED, F.col("p_partkey")).alias("declared"), pick([n for n, _ in LICENSE_PHRASES], F.col("p_size")).alias("identified"))
    agrees = license_matches(F.col("declared"), F.col("identified")).alias("agrees")
    return rows.groupBy("declared", "identified", agrees).agg(F.count("*").alias("n"))


def secret_scan(spark, sf_dir):
    files = V.files(spark, sf_dir)
    hits = S.credential_hits(files).groupBy("path").agg(F.count("*").alias("n"))
    tokens = files.where(F.col("content").rlike(S.GENERIC_TOKEN)).select("path")
    return tokens.join(hits, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("vendor_hits"))


def turn_word_overlap(spark, sf_dir):
    """Every turn as a comment against the next turn of its conversation as code, whole texts."""
    turns = V.read(spark, sf_dir, "conversations")
    notes = turns.select("conv_id", "turn", comment_words(F.col("text")).alias("words"))
    code = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), identifier_words(F.col("text")).alias("names"))
    pairs = notes.join(code, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(word_overlap(F.col("words"), F.col("names")), 6).alias("overlap"))


def stopword_filter(spark, sf_dir):
    return V.read(spark, sf_dir, "documents").select("doc_id", F.size(comment_words(F.col("text"))).alias("n_words"))


def convention_majority(spark, sf_dir):
    files = V.files(spark, sf_dir).select(
        F.col("repo_id").alias("dim"), F.col("language").alias("choice"), F.col("doc_id").alias("ord")
    )
    out = O.convention_majority(files)
    return out.select("dim", "majority", "n_files", F.round("minority", 6).alias("minority"))


def directory_fold(spark, sf_dir):
    docs = V.read(spark, sf_dir, "documents")
    deep = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.pmod("doc_id", F.lit(9)))
    counts = docs.select(deep.alias("path")).groupBy("path").agg(F.count("*").alias("files"))
    return G.fold_directories(counts, least=6)


def license_reading(spark, sf_dir):
    files = V.files(spark, sf_dir)
    named = files.withColumn("path", F.when(F.col("content").contains("License"), F.concat("path", F.lit("/LICENSE"))).otherwise(F.col("path")))
    return S.license_reading(named).select("repo_id", "file", "identified")


QUERIES = {f.__name__: f for f in (
    language_profile, sloc_per_file, file_index, exact_duplicate_files, clone_families_normalised, walk_caps, generated_header,
    license_fingerprint, license_matches_declared, secret_scan, turn_word_overlap, stopword_filter, convention_majority,
    directory_fold, license_reading,
)}
FILES = """WITH files AS (SELECT doc_id, source AS repo_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content,
  lang AS language FROM documents)"""
SLOC = """CASE WHEN content = '' THEN 0 ELSE len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]'))) END"""
FLAT = "lower(regexp_replace(content, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g'))"
LICENSE = "CASE " + " ".join(
    "WHEN " + " AND ".join(f"contains(t, '{p}')" for p in phrases) + f" THEN '{name}'" for name, phrases in LICENSE_PHRASES
) + " END"
COMMENT = r"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9\s\x0B]', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\s\x0B]+'),
  lambda w: length(w) > 1 AND NOT list_contains({1}, w))""".replace("{1}", str(list(STOP_WORDS)))
NAMES = r"""list_distinct(list_filter(flatten(list_transform(regexp_extract_all({0}, '[A-Za-z_$][A-Za-z0-9_$]*'),
  lambda n: regexp_split_to_array(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_$]+', ' ', 'g')), '\s+'))),
  lambda w: length(w) > 1))"""
ORACLES = {
    "language_profile": FILES + f""", per AS (SELECT language, count(*) AS files, CAST(sum({SLOC}) AS BIGINT) AS sloc FROM files GROUP BY language)
        SELECT language, files, sloc, round(sloc / sum(sloc) OVER (), 6)::DOUBLE AS share FROM per""",
    "sloc_per_file": FILES + f" SELECT path, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS lines, {SLOC} AS sloc FROM files",
    "file_index": FILES + """ SELECT path, '.txt' AS ext, CAST(strlen(content) AS BIGINT) AS size_bytes,
        CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS lines, sha1(content) AS sha1,
        false AS is_code, false AS is_test, contains(substr(content, 1, 1000), '@generated') AS is_generated FROM files""",
    "exact_duplicate_files": "SELECT sha1(text) AS sha1, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) >= 2",
    "clone_families_normalised": FILES + r""", shapes AS (SELECT path, length(content) AS weight,
        regexp_replace(regexp_replace(regexp_replace(content, '[0-9]+', '#', 'g'), '[\p{L}_]+', '$', 'g'), '[\s\x0B]+', ' ', 'g') AS shape FROM files)
        SELECT count(*) AS members, min(path) AS first_member, CAST(count(*) * max(weight) AS BIGINT) AS volume FROM shapes GROUP BY shape HAVING count(*) >= 2""",
    "walk_caps": FILES + """, sized AS (SELECT repo_id, path, CAST(strlen(content) AS BIGINT) AS size_bytes, strlen(content) > 12000 AS large FROM files),
        ranked AS (SELECT *, row_number() OVER w AS r, sum(size_bytes) OVER (PARTITION BY repo_id, large ORDER BY path ROWS UNBOUNDED PRECEDING) AS b
        FROM sized WINDOW w AS (PARTITION BY repo_id, large ORDER BY path))
        SELECT path, size_bytes, CASE WHEN large THEN 'oversized' WHEN r > 40 OR b > 60000 THEN 'truncated' ELSE 'read' END AS status FROM ranked""",
    "generated_header": FILES + """ SELECT path, contains(h, '@generated') OR regexp_matches(h, 'Code generated .*DO NOT EDIT|DO NOT EDIT THIS FILE|auto-?generated by', 'i') AS generated,
        regexp_matches(h, 'licensed under', 'i') AS license_header FROM (SELECT path, substr(content, 1, 1000) AS h FROM files)""",
    "license_fingerprint": FILES + f" SELECT path, {LICENSE} AS license FROM (SELECT path, {FLAT} AS t FROM files)",
    "license_matches_declared": f"""SELECT declared, identified, len(list_filter(regexp_split_to_array(upper(declared), '[^A-Z0-9.+-]+'),
        lambda t: t <> '' AND (starts_with(upper(identified), t) OR starts_with(t, upper(identified))))) > 0 AS agrees, count(*) AS n
        FROM (SELECT {list(DECLARED)}[p_partkey % {len(DECLARED)} + 1] AS declared, {[n for n, _ in LICENSE_PHRASES]}[p_size % {len(LICENSE_PHRASES)} + 1] AS identified FROM part) GROUP BY ALL""",
    "secret_scan": FILES + """ SELECT path, CAST(0 AS BIGINT) AS vendor_hits FROM files WHERE regexp_matches(content, 'token = "[0-9a-f]{40}"', 'i')""",
    "turn_word_overlap": f"""SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(n, x))) / len(w), 6) END AS overlap
        FROM (SELECT conv_id, turn, {COMMENT.replace('{0}', 'text')} AS w FROM conversations) JOIN
        (SELECT conv_id, turn - 1 AS turn, {NAMES.replace('{0}', 'text')} AS n FROM conversations) USING (conv_id, turn)""",
    "stopword_filter": f"SELECT doc_id, CAST(len({COMMENT.replace('{0}', 'text')}) AS INTEGER) AS n_words FROM documents",
    "convention_majority": """SELECT dim, arg_max(choice, {'n': n, 'o': -f}) AS majority, CAST(sum(n) AS BIGINT) AS n_files, round(1 - max(n) / sum(n), 6)::DOUBLE AS minority
        FROM (SELECT source AS dim, lang AS choice, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2) GROUP BY dim""",
    "directory_fold": """WITH c AS (SELECT source || '/' || lang || '/' || (doc_id % 9) AS path, source || '/' || lang AS p2, source AS p1, count(*) AS files FROM documents GROUP BY 1, 2, 3),
        a AS (SELECT *, CASE WHEN sum(files) OVER (PARTITION BY path) < 6 THEN p2 ELSE path END AS t3 FROM c),
        b AS (SELECT *, CASE WHEN t3 = p2 AND sum(files) OVER (PARTITION BY t3) < 6 THEN p1 ELSE t3 END AS t2 FROM a),
        d AS (SELECT *, CASE WHEN t2 = p1 AND sum(files) OVER (PARTITION BY t2) < 6 THEN '.' ELSE t2 END AS t1 FROM b)
        SELECT path, t1 AS target, files, CAST(sum(files) OVER (PARTITION BY t1) AS BIGINT) AS target_files FROM d""",
    "license_reading": FILES + f""", named AS (SELECT repo_id, path || '/LICENSE' AS path, {FLAT} AS t FROM files WHERE contains(content, 'License'))
        SELECT repo_id, path AS file, {LICENSE} AS identified FROM named QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) = 1""",
}
