"""Full-text, fusion and text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import fulltext as T
from lorekeep.operators import fusion as U
from lorekeep.operators.textindex import TextIndex, build
from lorekeep.scratch import scratch_path
from lorekeep.sources.tables import document_chunks, table, turn_chunks

TERMS = ["thing", "with", "ering"]
OTHER = ["from", "that", "ering"]
TOK = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


def docs(s, d):
    return document_chunks(table(s, d, "documents"))


_indexes: dict[tuple[str, str], TextIndex] = {}


def index(s, d):
    """The documents' stored index, built by the first query of a session that needs it."""
    key = (s.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = build(docs(s, d), scratch_path(s, "text-index"), 16)
    return _indexes[key]


def turns(s, d):
    return turn_chunks(table(s, d, "conversations"))


def lines(s, d):
    t = docs(s, d).select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return t


def tainted(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("line"))


def bm25_sql(terms, k, name="b"):
    listed = ", ".join(f"'{t}'" for t in terms)
    cut = f"ORDER BY score DESC, id LIMIT {k}" if k else ""
    return f"""{name}_t AS (SELECT doc_id AS id, {TOK} AS t FROM documents),
        {name}_n AS (SELECT count(*) AS n, avg(len(t)) AS average FROM {name}_t),
        {name}_p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM {name}_t) WHERE term IN ({listed}) GROUP BY ALL),
        {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
        {name} AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))), 6) AS score
            FROM {name}_p JOIN {name}_d USING (term) CROSS JOIN {name}_n GROUP BY id {cut})"""


_RANK = "row_number() OVER (ORDER BY score DESC, id)"
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card": r"[0-9]{13,16}",
    "phone": r"\+[0-9][0-9 ()-]{7,18}[0-9]",
}
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s'']', ' ', 'g'), '\\b(a|an|the|is|are|was|were)\\b', ' ', 'g'), '\\s+', ' ', 'g')"


def pii_counts(s, d):
    found = docs(s, d).select("id", *[F.regexp_count("text", F.lit(p)).alias(k) for k, p in _PII.items()])
    return found.where(" + ".join(_PII) + " > 0")


def more_like(s, d):
    return T.more_like_this(docs(s, d), 4, 10)


QUERIES = {
    "bm25_topk": (lambda s, d: index(s, d).bm25(TERMS, 20), f"WITH {bm25_sql(TERMS, 20)} SELECT id, score FROM b"),
    "bm25_scan": (lambda s, d: T.bm25(docs(s, d), TERMS, 20), f"WITH {bm25_sql(TERMS, 20)} SELECT id, score FROM b"),
    "bm25_facets": (
        lambda s, d: T.bm25(docs(s, d), TERMS, None).join(docs(s, d).select("id", "lang"), "id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 5).alias("best")),
        f"WITH {bm25_sql(TERMS, None)} SELECT lang, count(*) AS n, round(max(score), 5) AS best FROM b JOIN documents ON doc_id = id GROUP BY lang",
    ),
    "prf_terms": (
        lambda s, d: T.prf_terms(docs(s, d), TERMS),
        f"""WITH {bm25_sql(TERMS, 3)}, w AS (SELECT DISTINCT id, unnest({TOK}) AS term FROM (SELECT doc_id AS id, text FROM documents) WHERE id IN (SELECT id FROM b))
            SELECT term, count(*) AS df FROM w WHERE length(term) > 2 AND term NOT IN ({', '.join(f"'{x}'" for x in [*X.STOPWORDS['en'], *TERMS])})
            GROUP BY term ORDER BY df DESC, term LIMIT 8""",
    ),
    "more_like_this": (
        more_like,
        f"""WITH s AS (SELECT term, count(*) AS tf FROM (SELECT unnest({TOK}) AS term FROM documents WHERE doc_id = 4) GROUP BY term),
            q AS (SELECT term FROM s WHERE length(term) > 3 AND term NOT IN ({', '.join(f"'{x}'" for x in X.STOPWORDS['en'])}) ORDER BY tf, length(term) DESC, term LIMIT 10),
            t AS (SELECT doc_id AS id, {TOK} AS t FROM documents WHERE doc_id <> 4), n AS (SELECT count(*) AS n, avg(len(t)) AS average FROM t),
            p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM t) WHERE term IN (FROM q) GROUP BY ALL),
            f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
            SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))), 6) AS score
            FROM p JOIN f USING (term) CROSS JOIN n GROUP BY id ORDER BY score DESC, id LIMIT 10""",
    ),
    "suggest_prefix": (
        lambda s, d: index(s, d).suggest("th", 10),
        f"""SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) WHERE term LIKE 'th%' GROUP BY term ORDER BY n DESC, term LIMIT 10""",
    ),
    "vocabulary": (
        lambda s, d: T.vocabulary(docs(s, d), 20),
        f"SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term HAVING count(*) >= 20",
    ),
    "phrase_search": (
        lambda s, d: T.phrase_search(docs(s, d), ["of", "the"]),
        f"""WITH t AS (SELECT doc_id AS id, {TOK} AS t FROM documents), p AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t)
            SELECT x.id, count(*) AS hits FROM p x JOIN p y ON x.id = y.id AND y.i = x.i + 1 WHERE x.w = 'of' AND y.w = 'the' GROUP BY x.id""",
    ),
    "phrase_near": (
        lambda s, d: index(s, d).phrase(["thing", "with"], slop=4),
        f"""WITH t AS (SELECT doc_id AS id, {TOK} AS t FROM documents), p AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t)
            SELECT id, count(*) AS hits FROM (SELECT DISTINCT x.id, x.i FROM p x JOIN p y ON x.id = y.id AND abs(y.i - x.i) <= 4 WHERE x.w = 'thing' AND y.w = 'with') GROUP BY id""",
    ),
    "phrase_indexed": (
        lambda s, d: index(s, d).phrase(["of", "the"]),
        f"""WITH t AS (SELECT doc_id AS id, {TOK} AS t FROM documents), p AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t)
            SELECT x.id, count(*) AS hits FROM p x JOIN p y ON x.id = y.id AND y.i = x.i + 1 WHERE x.w = 'of' AND y.w = 'the' GROUP BY x.id""",
    ),
    "near_scan": (
        lambda s, d: T.phrase_search(docs(s, d), ["of", "with"], slop=3),
        f"""WITH t AS (SELECT doc_id AS id, {TOK} AS t FROM documents), p AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t)
            SELECT id, count(*) AS hits FROM (SELECT DISTINCT x.id, x.i FROM p x JOIN p y ON x.id = y.id AND abs(y.i - x.i) <= 3 WHERE x.w = 'of' AND y.w = 'with') GROUP BY id""",
    ),
    "prefix_scan": (
        lambda s, d: T.suggest(docs(s, d), "on", 10),
        f"""SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) WHERE term LIKE 'on%' GROUP BY term ORDER BY n DESC, term LIMIT 10""",
    ),
    "spell_correct": (
        lambda s, d: T.correct_spelling(s, docs(s, d), ["thign", "wiht", "frmo", "eringg"]),
        f"""WITH v AS (SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term HAVING count(*) >= 2),
            q AS (SELECT unnest(['thign', 'wiht', 'frmo', 'eringg']) AS query),
            r AS (SELECT query, term, levenshtein(query, term) AS edits, row_number() OVER (PARTITION BY query ORDER BY levenshtein(query, term), n DESC, term) AS r FROM q, v WHERE levenshtein(query, term) <= 2)
            SELECT query, term, CAST(edits AS INTEGER) AS edits FROM r WHERE r = 1""",
    ),
    "highlight": (
        lambda s, d: T.highlight(turns(s, d), TERMS),
        """SELECT conv_id * 1000 + turn AS id, CAST(len(regexp_extract_all(text, '(?i)\\b(thing|with|ering)\\b')) AS INTEGER) AS hits,
           regexp_replace(text, '(?i)\\b(thing|with|ering)\\b', '<b>\\1</b>', 'g') AS marked FROM conversations WHERE regexp_matches(text, '(?i)\\b(thing|with|ering)\\b')""",
    ),
    "rrf_fusion": (
        lambda s, d: U.rrf([T.bm25(docs(s, d), TERMS, 50), T.bm25(docs(s, d), OTHER, 50)]),
        f"""WITH {bm25_sql(TERMS, 50, 'x')}, {bm25_sql(OTHER, 50, 'y')},
            v AS (SELECT id, 1.0 / (60 + {_RANK}) AS vote FROM x UNION ALL SELECT id, 1.0 / (60 + {_RANK}) FROM y)
            SELECT id, round(sum(vote), 6) AS score FROM v GROUP BY id""",
    ),
    "weighted_fusion": (
        lambda s, d: U.weighted([(T.bm25(docs(s, d), TERMS, 50), 0.4), (T.bm25(docs(s, d), OTHER, 50), 0.6)]),
        f"""WITH {bm25_sql(TERMS, 50, 'x')}, {bm25_sql(OTHER, 50, 'y')},
            m AS (SELECT id, 0.4 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS part FROM x
                  UNION ALL SELECT id, 0.6 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) FROM y)
            SELECT id, round(sum(part), 6) AS score FROM m GROUP BY id""",
    ),
    "minmax_norm": (
        lambda s, d: U.normalised(T.bm25(docs(s, d), TERMS, 50)),
        f"WITH {bm25_sql(TERMS, 50)} SELECT id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM b",
    ),
    "exact_dup_chunks": (
        lambda s, d: docs(s, d).groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"),
        "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "near_dup_jaccard": (
        lambda s, d: T.similar_pairs(turns(s, d), "session_id", "id", "text", 0.1),
        f"""WITH t AS (SELECT conv_id AS block, conv_id * 1000 + turn AS id, list_distinct({TOK}) AS t FROM conversations)
            SELECT a.block, a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity
            FROM t a JOIN t b ON a.block = b.block AND a.id < b.id
            WHERE len(list_distinct(list_concat(a.t, b.t))) > 0 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.1""",
    ),
    "contamination_overlap": (
        lambda s, d: T.overlap_scan(lines(s, d), tainted(s, d), 0.3),
        f"""WITH l AS (SELECT id, line_no, list_distinct(regexp_extract_all(lower(line), '[a-z0-9'']+')) AS t FROM (
                SELECT doc_id AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)),
            b AS (SELECT item_id AS item, list_distinct({TOK}) AS t FROM benchmark),
            x AS (SELECT id, line_no, item, len(list_intersect(l.t, b.t)) AS shared, len(l.t) AS na, len(b.t) AS nb FROM l, b WHERE len(l.t) > 0 AND len(b.t) >= 4)
            SELECT id, line_no, item, round(shared / (na + nb - shared), 6) AS overlap FROM x WHERE shared / (na + nb - shared) >= 0.3""",
    ),
    "pii_scan_counts": (
        pii_counts,
        "SELECT * FROM (SELECT doc_id AS id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {k}" for k, p in _PII.items()) + " FROM documents) WHERE email + ipv4 + card + phone > 0",
    ),
    "lang_facets": (
        lambda s, d: docs(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")),
        "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    ),
    "script_facets": (
        lambda s, d: docs(s, d).groupBy(X.detect_script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'en' AS script, count(*) AS n FROM documents",
    ),
    "token_estimate": (
        lambda s, d: docs(s, d).select("id", X.token_estimate(F.col("text")).alias("tokens")),
        """SELECT doc_id AS id, CAST(greatest(1, round_even(CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS DOUBLE) * CAST(1.3 AS DOUBLE), 0)) AS INTEGER) AS tokens FROM documents""",
    ),
    "neighbor_turns": (
        lambda s, d: T.neighbours(turns(s, d), turns(s, d).where("position = 2").select("id"), 1, 1).select("centre", "id", "offset"),
        """SELECT c.conv_id * 1000 + c.turn AS centre, n.conv_id * 1000 + n.turn AS id, CAST(n.turn - c.turn AS INTEGER) AS offset
           FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn BETWEEN c.turn - 1 AND c.turn + 1 WHERE c.turn = 2""",
    ),
    "word_counts": (
        lambda s, d: turns(s, d).select("id", F.size(X.words(F.col("text"))).alias("words"), F.size(X.content_words(F.col("text"))).alias("content")),
        f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[a-z][a-z''’-]*|\\d+(?:\\.\\d+)?') AS w FROM conversations)
            SELECT id, CAST(len(w) AS INTEGER) AS words, CAST(len(list_filter(w, lambda x: length(x) > 1 AND x NOT IN ({', '.join(f"'{x}'" for x in X.STOPWORDS['en'])}))) AS INTEGER) AS content FROM w""",
    ),
    "normalised_turns": (
        lambda s, d: turns(s, d).select("id", X.normalise(F.col("text")).alias("plain")),
        f"SELECT conv_id * 1000 + turn AS id, trim({_CLEAN}) AS plain FROM conversations",
    ),
    "relation_slugs": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.safe_relation(F.col("p_name")).alias("slug"), X.clean_value(F.col("p_type")).alias("kind")),
        "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, p_type AS kind FROM part",
    ),
    "fuzzy_names": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", F.round(X.fuzzy_score(F.col("n_name"), F.lit("nation_3")), 6).alias("score"), F.levenshtein("n_name", F.lit("NATION")).alias("edits")),
        """WITH g AS (SELECT n_nationkey, lower(n_name) AS a, 'nation_3' AS b, levenshtein(n_name, 'NATION') AS edits FROM nation),
           s AS (SELECT *, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS ga, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS gb FROM g)
           SELECT n_nationkey, round(0.7 * (1 - levenshtein(a, b) / greatest(length(a), length(b), 1)) + 0.3 * len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 6) AS score,
                  CAST(edits AS INTEGER) AS edits FROM s""",
    ),
}
