"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from ..session import fresh_path, materialize
from . import chat_tree, chunks, decontaminate, pfair, prefix_trie, probminhash, quality, spelling, substrings, token_counts, token_files, url_rules, voronoi
from .pieces_bpe import tokenizer_path
from .registry import QUERIES, SQL, query, table  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
CHAT_TOKENIZER = "byte_bpe_50k.json"


@query()
def op6_prefix_counts(spark, sf):
    counts = token_counts.prefix_counts(table(spark, sf, "documents"), tokenizer_path(TOKENIZER))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query()
def op9_token_files(spark, sf):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), path, tokenizer_path(TOKENIZER))
    return token_files.read_tokens(spark, path)


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(sql=f"""
    WITH item AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    win AS (
      SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
    doc AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
    here AS (
      SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc JOIN (SELECT DISTINCT n FROM win) ON len(w) >= n)),
    hit AS (SELECT r, n, i, item_id FROM here JOIN win USING (n, t)),
    place AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
    found AS (
      SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN place USING (r) LEFT JOIN found USING (r)""")
def op8_decontaminate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf, "benchmark"), keep_text=False)
    return marked.select(
        "doc_id", F.col(decontaminate.WORDS).alias("n_words"), decontaminate.n_hit().alias("n_hit"),
        F.size(decontaminate.ITEMS).cast("long").alias("n_items"), F.sha2(F.array_join(decontaminate.ITEMS, ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query()
def op7_mix_sources(spark, sf):
    plan = pfair.schedule(table(spark, sf, "documents"))
    return plan.select("doc_id", "source", "n_rows", "n_bytes", "block", "release", "deadline", "slot")


@query(sql=r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(i, r)),
    e AS (
      SELECT *, length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) + length(text) + len(regexp_extract_all(text, '<\\*\|'))
        + length(shown) + len(regexp_extract_all(shown, '<\\*\|')) AS n
      FROM (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS shown FROM t))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(n)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id""")
def op10_chat_tree(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    path = fresh_path(spark, "chat")
    chat_tree.write_tree(rows.unionByName(extra), path, tokenizer_path(CHAT_TOKENIZER), conv="conv_id")
    return chat_tree.read_tree(spark, path)


@query()
def op1_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf, "labels")))


@query()
def op5_near_duplicates(spark, sf):
    return probminhash.near_duplicates(table(spark, sf, "documents"))


@query()
def op4_suffix_arrays(spark, sf):
    out = substrings.remove_repeated(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


@query(sql="""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op2_voronoi_join(spark, sf):
    vectors = materialize(voronoi.whole_vectors(table(spark, sf, "embeddings")), "vectors")
    return voronoi.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query()
def op3_chunk_dedup(spark, sf):
    return chunks.remove_repeated_chunks(table(spark, sf, "documents"))


URL_RULES = [
    url_rules.host_rule(url_rules.ALLOW, "com"), url_rules.host_rule(url_rules.BLOCK, "example.com", "/en/"),
    url_rules.host_rule(url_rules.ALLOW, "www.example.com", "/en/"), url_rules.host_rule(url_rules.BLOCK, "net", "/es/"),
    url_rules.host_rule(url_rules.BLOCK, "net", "/fr/"),
]


@query(sql=f"""
    WITH rules(action, rule_host, rule_path) AS (VALUES
      ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    page AS (
      SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    part AS (
      SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM page),
    fit AS (
      SELECT r, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC) AS k
      FROM part JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM part LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (r)""")
def op12_url_rules(spark, sf):
    return url_rules.judge(table(spark, sf, "pages"), URL_RULES)


# The unsigned crc32 of a list of bytes, by the table of its rule.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t"""
_CRC = "xor(list_reduce(list_prepend(4294967295, {}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
HEAD_STEP, HEAD_KINDS = 20, 4


@query(sql=rf"""
    WITH tab AS ({_CRC_TABLE}),
    said AS (
      SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS dg, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) - 1 AS pos FROM said),
    c AS (
      SELECT conv_id, conv_id - conv_id % {HEAD_STEP} AS base,
        {_CRC.format("list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)")} % {HEAD_KINDS} AS h
      FROM (SELECT DISTINCT conv_id FROM p), tab),
    r AS (
      SELECT c.conv_id, pos, 0 AS own, dg, words FROM c JOIN p ON p.conv_id = base AND pos < h
      UNION ALL SELECT conv_id, pos, 1, dg, words FROM c JOIN p USING (conv_id) WHERE pos >= h),
    s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, dg, words FROM r),
    path AS (
      SELECT conv_id, depth, words, string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    node AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n FROM path GROUP BY node),
    kids AS (SELECT left(node, length(node) - 64) AS node, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
    own AS (SELECT node.*, coalesce(k, 0) AS k, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * words AS saved FROM node LEFT JOIN kids USING (node)),
    total AS (
      SELECT path.node, sum(leaf)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
      FROM own JOIN path ON own.conv_id = path.conv_id AND path.depth <= own.depth GROUP BY path.node),
    ends AS (
      SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h
      FROM (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node)
    SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n AS n_convs, own.k AS n_children, leaves AS n_leaves, total.saved AS saved_tokens,
      coalesce(ends.h, sha256('')) AS ends_sha256
    FROM own JOIN total USING (node) LEFT JOIN ends USING (node) LEFT JOIN node AS up ON own.depth > 0 AND up.node = left(own.node, length(own.node) - 64)""")
def op11_prefix_trie(spark, sf):
    rows = materialize(prefix_trie.turn_rows(table(spark, sf, "conversations")), "rows")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_KINDS
    return prefix_trie.trie(*prefix_trie.with_borrowed_heads(rows, HEAD_STEP, head, HEAD_KINDS - 1))


@query(sql=rf"""
    WITH RECURSIVE tab AS ({_CRC_TABLE}),
    run AS (
      SELECT id, translate(r, '{ascii_uppercase}', '{ascii_lowercase}') AS r, count(*) AS k
      FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) AS r FROM documents) GROUP BY ALL),
    hashed AS (
      SELECT r, k, {_CRC.format("list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)")} AS h
      FROM (SELECT r, k, hex(encode(id || ':' || r)) AS x FROM run), tab),
    seen AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM seen WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    cut AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    longer AS (SELECT DISTINCT cut.word AS a, words.word AS b FROM cut JOIN words ON d = words.word),
    pair AS (
      SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
      UNION ALL SELECT a, b FROM longer UNION ALL SELECT b, a FROM longer),
    ranked AS (
      SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS near FROM pair JOIN words ON b = words.word),
    formed AS MATERIALIZED (
      SELECT word, words.n, coalesce(near, 0) AS n_near, CASE WHEN ranked.n >= 10 * words.n THEN b END AS form, CASE WHEN ranked.n >= 10 * words.n THEN ranked.n END AS form_n
      FROM words LEFT JOIN ranked ON a = word AND k = 1),
    chain AS (
      SELECT word, coalesce(form, word) AS root, 0 AS steps FROM formed
      UNION ALL SELECT chain.word, formed.form, steps + 1 FROM chain JOIN formed ON formed.word = root WHERE formed.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)""")
def op13_spelling(spark, sf):
    return spelling.spelling_variants(table(spark, sf, "documents"))
