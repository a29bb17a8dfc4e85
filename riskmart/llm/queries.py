"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.llm import common


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import packing

    return packing.pack_documents(common.table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import langid

    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~common.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", F.col("lang_score").alias("score"))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import quality

    x = common.materialise(quality.features(common.table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(x, common.table(spark, sf_dir, "labels").where(~common.held_out()))
    return quality.score(x, model).select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import token_files

    path = common.new_path(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents"), path)
    return token_files.digests(spark, path)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import simhash

    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import licenses

    found = licenses.scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "rule", "license", "n_matches", F.array_join("sentence_ids", ",").alias("sentence_ids"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import substrings

    cut = substrings.remove_repeats(common.table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import decontamination

    return decontamination.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found toxic, with the probabilities of all categories."""
    from riskmart.llm import toxicity

    docs = common.table(spark, sf_dir, "documents")
    labels = toxicity.sample_labels(common.table(spark, sf_dir, "labels").where("toxic is not null").where(~common.held_out()))
    chain = toxicity.fit(toxicity.with_labels(docs, F.broadcast(labels)))
    return toxicity.predict(docs, chain).where("is_toxic")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import embeddings

    return embeddings.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import topk

    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskmart.llm import resampling

    return resampling.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their repair; those without a row after the damage have zeros."""
    from riskmart.llm import conversations

    rows = common.table(spark, sf_dir, "conversations")
    found = conversations.digests(conversations.repair(conversations.damage(rows)))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    joined = every.alias("e").join(found.withColumnRenamed("conv_id", "_id"), F.col("e.conv_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("conv_id", *[c.alias(k) for k, c in none.items()])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (op1_packing, op2_langid, op3_quality, op4_token_files, op5_simhash, op6_licenses, op7_substring_dedup, op8_decontamination, op9_toxicity, op10_embeddings, op11_topk, op12_resampling, op13_conversations, pipeline)
}


def _licenses_sql() -> str:
    """The same cuts in the other engine's patterns, which look neither ahead nor behind: each cut is doubled, so that sentences next to each other have one each on both sides. The matches are rows, known by a join."""
    from riskmart.llm.licenses import _GAP_PATTERN, _GAP_WORD, GAP, RULES, SENTENCES

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def cut(x: str) -> str:
        out = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for pattern, by in (
            (r"\r\n?", "\n"),
            (r"\f", " "),
            (r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*", "\r"),
            (r"\n[^\p{L}\p{N}\n]*", "\n"),
            (r"[.;:](?:[ \t\x0B]+\n?|\n)", "\f"),
            (r"[^\p{L}\p{N}.\n\r\f]+", " "),
            (r"[ .]+([\n\r\f]|\z)", r"\1"),
            (r"(\A|[\n\r\f])[ .]+", r"\1"),
            (r"[\n\f]*\r[\n\r\f]*", "\r"),
            (r"\n*\f[\n\f]*", "\f"),
        ):
            out = f"regexp_replace({out}, {text(pattern)}, {text(by)}, 'g')"
        return out

    def plain(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n\\r\\f]+', ' ', 'g'))"

    known = ", ".join(f"({text(x.replace(GAP, _GAP_WORD))}, {text(k)})" for k, xs in SENTENCES.items() for x in xs)
    keys = {rule: "".join(f"|{x}|" for x in seq) for rule, _, seq in RULES}
    rules = ", ".join(f"({text(rule)}, {text(license_)}, {text(keys[rule])})" for rule, license_, _ in RULES)
    return f"""
    WITH known AS (SELECT DISTINCT {plain(cut("t"))} AS sentence, id FROM (VALUES {known}) v(t, id)),
    rules(rule, license, key) AS (VALUES {rules}),
    pattern AS (SELECT '[\n\r\f]((?:' || string_agg(replace(replace(replace(sentence, '.', '[.]'), ' ', '(?: |\n\n|\f\f)'), '{_GAP_WORD}', '[^\r]{_GAP_PATTERN}'), ')|(?:' ORDER BY length(sentence) DESC, sentence) || '))[\n\r\f]' AS p FROM known),
    docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(chr(13) || {cut("text")} || chr(13), '([\n\r\f])', '\\1\\1', 'g') AS t FROM documents),
    found AS (SELECT doc_id, r, regexp_extract_all(t, (SELECT p FROM pattern), 1) AS parts FROM docs),
    sentences AS (SELECT doc_id, r, generate_subscripts(parts, 1) AS n, unnest(parts) AS part FROM found),
    named AS (SELECT DISTINCT r, doc_id, n, id FROM sentences JOIN known ON {plain("part")} = sentence OR (contains(sentence, '{_GAP_WORD}') AND regexp_matches({plain("part")}, '^' || replace(replace(sentence, '.', '[.]'), '{_GAP_WORD}', '.{_GAP_PATTERN}') || '$'))),
    ids AS (SELECT r, doc_id, list(id ORDER BY n) AS ids FROM named GROUP BY r, doc_id),
    hits AS (SELECT r, doc_id, ids, rule, license, key, (length(j) - length(replace(j, key, ''))) // length(key) AS n
             FROM (SELECT *, '|' || array_to_string(ids, '||') || '|' AS j FROM ids) CROSS JOIN rules),
    own AS (SELECT h.r, h.doc_id, h.ids, h.rule, h.license, h.n - coalesce(sum(l.n), 0) AS n FROM hits h
            LEFT JOIN hits l ON l.r = h.r AND l.key <> h.key AND contains(l.key, h.key)
                AND NOT EXISTS (SELECT 1 FROM rules m WHERE m.key NOT IN (l.key, h.key) AND contains(m.key, h.key) AND contains(l.key, m.key))
            GROUP BY h.r, h.doc_id, h.ids, h.rule, h.license, h.key, h.n)
    SELECT doc_id, rule, license, CAST(n AS BIGINT) AS n_matches, array_to_string(ids, ',') AS sentence_ids FROM own WHERE n > 0"""


#: Every window as a string (words hold no space), counted; then word by word.
_SUBSTRINGS_SQL = """
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs)),
    again AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN again USING (x)),
    every AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t FROM every ANTI JOIN gone USING (r, k) GROUP BY r),
    n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM docs LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""
#: Every pair, and all that links reach.
_EMBEDDINGS_SQL = """
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least_b, vec_id)) AS component_id, coalesce(vec_id = least(vec_id, coalesce(least_b, vec_id)), false) AS kept
    FROM v LEFT JOIN (SELECT r, count(*) AS n FROM links GROUP BY r) USING (r) LEFT JOIN (SELECT a, min(b) AS least_b FROM reach GROUP BY a) x ON x.a = v.vec_id"""
#: All scores, ranked.
_TOPK_SQL = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    whole AS (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS x FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.x) = len(c.x))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= 20"""
#: The CRC of each distinct feature, byte by byte, as a string.
_RESAMPLING_SQL = r"""
    WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
of_docs AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM docs),
of_items AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM items),
bytes AS (SELECT g, list_transform(range(length(hex(g)) // 2), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT g FROM of_docs UNION SELECT g FROM of_items)),
bucket AS (SELECT g, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS b FROM bytes, crc_table),
s AS (SELECT b, count(*) AS n FROM of_docs JOIN bucket USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM of_items JOIN bucket USING (g) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
weight AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS w FROM of_docs JOIN bucket USING (g) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, len(docs.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight.w, 0) AS weight, coalesce(weight.w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weight USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM placed"""

def _conversations_sql() -> str:
    """The least way to each state, row by row; ways are strings, least by cost and then by edits."""

    def plus(way: str, n: int | str, letter: str, line: str = "NULL") -> str:
        """A way with another edit; a way is its cost in nine digits, its edits, chr(1) and its rows. Of two ways to one state the lesser text is the better."""
        kept = f"{way}[instr({way}, chr(1)):]" + (f" || CASE WHEN {way}[-1:] = chr(1) THEN '' ELSE chr(10) END || {line}" if line != "NULL" else "")
        return f"printf('%09d', CAST({way}[1:9] AS BIGINT) + {n}) || {way}[10:instr({way}, chr(1)) - 1] || '{letter}' || {kept}"
    inserted = f"""SELECT g, k, e, s, u, least(a, {plus('u', 2, 'I', "'assistant:'")}) AS a FROM (SELECT g, k, e, s, a, least(u, {', '.join(plus(w, 2, 'I', "'user:'") for w in 'esa')}) AS u FROM {{0}}) z"""
    keep, rerole = lambda w: plus(w, "late", "K", "role || ':' || text"), lambda w, to: plus(w, "2 + late", "R", f"'{to}:' || text")
    return f"""
    WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
    told AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER () AS r, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
    marked AS (SELECT *, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 20 AS kind FROM told, crc_table),
    damaged AS (SELECT g, r, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM marked),
    turns AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, r, copy) AS k, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS mark FROM damaged),
    seen AS (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, lag(role[1:1]) OVER (PARTITION BY g ORDER BY k) || role[1:1] AS pair FROM turns),
    way AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, repeat('0', 9) || chr(1) AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM told
        UNION ALL SELECT g, k, {plus('e', 3, 'D')}, least({plus('s', 3, 'D')}, CASE WHEN stays AND c = 's' THEN {keep('e')} END),
            least({plus('u', 3, 'D')}, {', '.join(f"CASE WHEN stays AND c = 'u' THEN {keep(w)} END, CASE WHEN stays THEN {rerole(w, 'user')} END" for w in 'esa')}),
            least({plus('a', 3, 'D')}, CASE WHEN stays AND c = 'a' THEN {keep('u')} END, CASE WHEN stays THEN {rerole('u', 'assistant')} END)
        FROM (SELECT w.g, n.k, w.e, w.s, w.u, w.a, n.role, n.text, n.role[1:1] AS c, n.fault NOT IN ('blank', 'duplicate') AS stays, CAST(n.fault = 'truncated' AS INTEGER) AS late FROM ({inserted.format('way')}) w JOIN seen n ON n.g = w.g AND n.k = w.k + 1) x),
    ended AS (SELECT g, least(e, a) AS best FROM ({inserted.format('(SELECT * FROM way QUALIFY k = max(k) OVER (PARTITION BY g)) y')}) v),
    counted AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN fault = 'blank' THEN 1 END) AS blank, count(CASE WHEN fault = 'duplicate' THEN 1 END) AS duplicate, count(CASE WHEN fault = 'truncated' THEN 1 END) AS truncated, count(CASE WHEN pair NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal FROM seen GROUP BY g)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best[1:9] AS BIGINT) AS cost, best[10:instr(best, chr(1)) - 1] AS audit, sha256(best[instr(best, chr(1)) + 1:]) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id) AS g FROM conversations) JOIN ended USING (g) LEFT JOIN counted USING (g)"""


ORACLES: dict[str, str] = {"op6_licenses": _licenses_sql(), "op7_substring_dedup": _SUBSTRINGS_SQL, "op10_embeddings": _EMBEDDINGS_SQL, "op11_topk": _TOPK_SQL, "op12_resampling": _RESAMPLING_SQL, "op13_conversations": _conversations_sql()}
