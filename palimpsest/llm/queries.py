"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` with its links and component (see ``near_duplicates``)."""
    from palimpsest.llm.neighbours import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored by a model of ``labels`` that are not held out (see ``score``)."""
    from palimpsest.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(spark, docs, train(docs, table(spark, sf_dir, "labels")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages`` (see ``extract``)."""
    from palimpsest.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of every row of ``pages``, as read back from the archives (see ``archive_pages``)."""
    from palimpsest.llm.warc import archive_pages

    return archive_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of ``conversations`` with their results (see ``link``)."""
    from palimpsest.llm.tool_calls import REPLY, from_conversations, link

    calls, results = from_conversations(table(spark, sf_dir, "conversations"))
    return link(spark, calls, results, {"reply": REPLY})


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every row of ``embeddings`` whose vec_id is divisible by 50 (see ``nearest``)."""
    from palimpsest.llm.hamming import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its component (see ``jaccard_components``)."""
    from palimpsest.llm.jaccard import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes (see ``mix``)."""
    from palimpsest.llm.mixing import mix

    return mix(spark, table(spark, sf_dir, "documents")).drop("source")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every length of ``documents`` in tokens what its suffix sums answer (see ``token_counts``)."""
    from palimpsest.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row of ``documents`` in its sequence (see ``pack``)."""
    from palimpsest.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every row of ``documents`` (see ``scan``)."""
    from palimpsest.llm.secret_scan import scan

    return scan(spark, table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source of ``documents`` differs from the others of its language (see ``divergence``)."""
    from palimpsest.llm.divergence import divergence

    return divergence(spark, table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters does to every source of ``documents`` (see ``audit``)."""
    from palimpsest.llm.filter_audit import audit

    return audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_neighbours, op2_toxicity, op3_html, op4_warc, op5_tool_calls, op6_hamming, op7_jaccard, op8_mixing, op9_token_counts, op10_packing, op11_secret_scan, op12_divergence, op13_filter_audit)
}

ORACLE_SQL = {
    # The SHA-1 of DuckDB is hexadecimal; its bytes are written in base32 five bits at a time.
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
        b AS (SELECT *, list_aggregate(list_transform(string_split(hex, ''), lambda c: right(bin(CAST('0x' || c AS INT) + 16), 4)), 'string_agg', '') AS bits FROM d)
        SELECT page_id, payload_bytes,
          list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, 1 + 5 * i + j, 1) = '1' THEN power(2, 4 - j) ELSE 0 END)) AS INT), 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM b""",
    "op5_tool_calls": """
        WITH RECURSIVE c AS (
          SELECT conv_id, turn, 'c' || conv_id || '_' || turn AS call_id, text,
            CASE WHEN turn % 8 > 1 THEN 'c' || conv_id || '_' || (turn - 2) END AS after
          FROM conversations WHERE role = 'user'),
        r AS (SELECT conv_id, 'c' || conv_id || '_' || (turn - 1) AS call_id, arg_min(text, turn) AS content, count(*) AS n
          FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
        lv AS (
          SELECT conv_id, call_id, 0 AS level FROM c WHERE after IS NULL OR NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
          UNION ALL
          SELECT c.conv_id, c.call_id, lv.level + 1 FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.after = lv.call_id)
        SELECT c.conv_id, c.turn, c.call_id, CAST(lv.level AS INT) AS level,
          row_number() OVER (PARTITION BY c.conv_id ORDER BY lv.level, c.turn, c.call_id) - 1 AS position,
          coalesce(r.n, 0) AS n_results,
          '{"arguments":{"after":' || coalesce(CAST(to_json(c.after) AS VARCHAR), 'null') || ',"text":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"call_id":"' || c.call_id || '","conv_id":' || c.conv_id
            || ',"name":"reply","result":' || CASE WHEN r.n IS NULL THEN 'null' ELSE '{"content":' || CAST(to_json(r.content) AS VARCHAR) || '}' END || '}' AS json,
          c.text <> '' AS valid, CASE WHEN c.text = '' THEN '$.text: length' ELSE '' END AS errors,
          CASE WHEN r.n IS NULL THEN 'open' ELSE 'linked' END AS status
        FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.call_id = lv.call_id LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id""",
    # every pair over all kept terms, absent ones too
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT d.lang, d.source, coalesce(max(s.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000 * (k.total + 1)) // (v.n + v.v) AS q
          FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        x AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
    # every order from the bits of the filters that a text fails, without sets of prefixes
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
        b AS (SELECT part,
            doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
            map {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
              'C': 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails
          FROM w),
        g AS (SELECT part, fails['A'] AS a, fails['B'] AS b, fails['C'] AS c, fails['D'] AS d, fails['E'] AS e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
          FROM b GROUP BY ALL),
        f AS (SELECT part, n, good, toxic, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails FROM g),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        o AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM l v JOIN l w ON w.l <> v.l JOIN l x ON x.l NOT IN (v.l, w.l) JOIN l y ON y.l NOT IN (v.l, w.l, x.l) JOIN l z ON z.l NOT IN (v.l, w.l, x.l, y.l)),
        s AS (SELECT filter_order, step, filter_order[step] AS x, string_split(left(filter_order, step - 1), '') AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
        r AS (SELECT part, filter_order, step, x, n, good, toxic, fails[x] AS failing, len(list_filter(before, lambda k: k <> '' AND fails[k])) = 0 AS alive,
            len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: k <> x AND fails[k])) = 0 AS alone
          FROM f, s),
        t AS (SELECT part, filter_order, step, x,
            CAST(coalesce(sum(n) FILTER (alive AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (alive AND failing), 0) AS BIGINT) AS removed,
            CAST(coalesce(sum(n) FILTER (failing AND NOT alive), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failing AND alone), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(good) FILTER (alive AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (alive AND failing), 0) AS BIGINT) AS toxic_lost
          FROM r GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t""",
}
