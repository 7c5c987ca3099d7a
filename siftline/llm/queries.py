"""The registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.codes import fresh_target, read_documents, write_ids

    target = write_ids(table(spark, sf_dir, "documents"), fresh_target(spark), tokenizer_path("word_bpe_49k.json"))
    return read_documents(spark, target)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.chat_format import format_turns, read_back

    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return read_back(format_turns(turns))


#: fixed values: host, path, action
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.conversation_repair import damaged, repair_report

    turns = table(spark, sf_dir, "conversations")
    return repair_report(damaged(turns), turns)


def op13_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op6_approximate_neighbours": op6_approximate_neighbours,
    "op7_toxicity": op7_toxicity,
    "op1_chat_formatting": op1_chat_formatting,
    "op2_url_filter": op2_url_filter,
    "op8_secret_scan": op8_secret_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_id_output": op4_token_id_output,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_compression": op13_vector_compression,
}

#: what both words and windows of op11 start from; RE2 knows the class as it is
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _op12_sql() -> str:
    """A recursion over rows: per state the least (cost, audit) with the turns it makes."""
    least = lambda ways: f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"
    one = lambda s, c, a, made: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + {c}, 'audit': {s}.audit || '{a}', 'made': {s}.made || {made}}} END"
    user, assistant = "['user:']", "['assistant:']"
    both = "['user:', 'assistant:']"
    # inserts before a row or after the last
    i = {
        0: "q0", 1: "q1",
        2: least(["q2", one("q0", 2, "I", user), one("q1", 2, "I", user), one("q3", 2, "I", user)]),
        3: least(["q3", one("q2", 2, "I", assistant), one("q0", 4, "II", both), one("q1", 4, "II", both)]),
    }
    said = "[(role || ':' || text)]"
    way = lambda s, c, a, when, made: f"CASE WHEN {when} AND {s} IS NOT NULL THEN {{'cost': {s}.cost + {c}, 'audit': {s}.audit || '{a}', 'made': {made}}} END"
    drop = lambda q: way(f"i{q}", 3, "D", "true", f"i{q}.made")
    keep = lambda p, who: way(f"i{p}", "cut", "K", f"ok AND who = '{who}'", f"i{p}.made || {said}")
    turn = lambda p, role: way(f"i{p}", "2 + cut", "R", "ok", f"i{p}.made || [('{role}:' || text)]")
    q = {
        0: [drop(0)],
        1: [drop(1), keep(0, "s")],
        2: [drop(2), *(keep(p, "u") for p in (0, 1, 3)), *(turn(p, "user") for p in (0, 1, 3))],
        3: [drop(3), keep(2, "a"), turn(2, "assistant")],
    }
    state = "STRUCT(cost BIGINT, audit VARCHAR, made VARCHAR[])"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda k: CAST(ascii(key[k]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    return rf"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
        ), hashed AS (SELECT *, {crc} % 20 AS h FROM keyed),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM hashed WHERE h <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, left(role, 1) AS who
            FROM hurt
        ), judged AS (
            SELECT *, NOT blank AND nth > 1 AS dup, NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS short,
                   coalesce(lag(who) OVER (PARTITION BY conv_id ORDER BY k) || who NOT IN ('su', 'ua', 'au'), false) AS bad
            FROM placed
        ), ready AS (SELECT *, NOT blank AND NOT dup AS ok, CAST(short AS INTEGER) AS cut FROM judged),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        steps AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST({{'cost': 0, 'audit': '', 'made': []}} AS {state}) AS q0,
                   CAST(NULL AS {state}) AS q1, CAST(NULL AS {state}) AS q2, CAST(NULL AS {state}) AS q3 FROM ids
            UNION ALL
            SELECT conv_id, k, {', '.join(f'CAST({least(q[s])} AS {state}) AS q{s}' for s in range(4))}
            FROM (SELECT s.conv_id, r.k, role, text, who, ok, cut, {', '.join(f'{i[s]} AS i{s}' for s in range(4))}
                  FROM steps s JOIN ready r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = s.k + 1)
        ), ends AS (
            SELECT conv_id, list_sort(list_filter([q0, {i[3]}], lambda x: x IS NOT NULL))[1] AS best
            FROM (SELECT conv_id, arg_max(q0, k) AS q0, arg_max(q1, k) AS q1, arg_max(q2, k) AS q2, arg_max(q3, k) AS q3
                  FROM (SELECT s.*, max(k) OVER (PARTITION BY conv_id) AS last FROM steps s) WHERE k = last GROUP BY conv_id)
        ), sums AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (dup) AS duplicate, count(*) FILTER (short) AS truncated, count(*) FILTER (bad) AS illegal FROM judged GROUP BY conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.made, chr(10))) AS repaired_sha256
        FROM ends e LEFT JOIN sums s ON e.conv_id IS NOT DISTINCT FROM s.conv_id"""


def _op13_sql() -> str:
    """Full searches, one pair of steps for each round."""
    nearest = lambda book: f"""(
            SELECT id, part, least % 256 AS entry, least // 256 AS d FROM (
                SELECT v.id, v.part, min(256 * list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) + c.entry) AS least
                FROM parts v JOIN {book} c USING (part) GROUP BY 1, 2))"""  # noqa: E731
    steps = []
    for n in range(5):
        steps.append(f"near{n} AS MATERIALIZED {nearest(f'book{n}')}")
        if n < 4:
            steps.append(f"""book{n + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(moved.x, b.x) AS x FROM book{n} b LEFT JOIN (
                SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS x
                FROM (SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(v.x) AS c, unnest(range(len(v.x))) AS i FROM near{n} a JOIN parts v USING (id, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2) moved USING (part, entry))""")
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), parts AS MATERIALIZED (SELECT id, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM kept, range(4) AS p(part)),
        book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM parts WHERE id <= 256),
        {', '.join(steps)},
        coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book4) AS codebooks_sha256
        FROM kept JOIN coded USING (id)"""


ORACLES = {
    "op1_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *,
                   (length(text) - length(replace(text, '</turn>', ''))) // 7
                   + (length(text) - length(replace(text, '### ', ''))) // 4 AS n_text,
                   length(role) - length(replace(replace(replace(role, '\', ''), ':', ''), chr(10), '')) AS n_role
            FROM rows
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(15 + length(role) + n_role + length(text) + n_text) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op2_url_filter": """
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), ruled AS (
            SELECT *,
                   CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
                   END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, k, array_to_string(w[j : j + k - 1], ' ') AS words
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))
        ), runs AS (
            SELECT r, k, j, array_to_string(w[j : j + k - 1], ' ') AS words
            FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM windows))
        ), hits AS (SELECT r, k, j, item FROM runs JOIN windows USING (k, words)),
        places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(j, j + k)) AS p FROM (SELECT DISTINCT r, k, j FROM hits)) GROUP BY r),
        items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN places p USING (r) LEFT JOIN items i USING (r)
    """,
    "op12_conversation_repair": _op12_sql(),
    "op13_vector_compression": _op13_sql(),
}
