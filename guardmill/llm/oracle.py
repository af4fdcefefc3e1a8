"""SQL twins, written for DuckDB and only from the definition of each result."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(COALESCE({text}, ''), '{_WORD}')"


def _crc32(text: str) -> str:
    """Bit by bit: 3988292384 is the reversed polynomial."""
    data = (f"list_transform(regexp_extract_all(hex(encode(COALESCE({text}, ''))), '..'), "
            f"lambda h: ('0x' || h)::BIGINT)")
    step = ("list_reduce([0, 1, 2, 3, 4, 5, 6, 7], "
            "lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))")
    return f"xor(list_reduce({data}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


_FOLD = ("translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz')")

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(_FOLD)} AS w FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3),
        lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b
    ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * o >= 75 * (x.n + y.n - o)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  c AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
  SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(c.least, d.doc_id) AS component_id
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""

#: The same links, and how many a document has.
NGRAM_LINKS = NGRAM_JOIN[:NGRAM_JOIN.rindex("  SELECT")].rstrip() + """,
  k AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
  SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(c.least, d.doc_id) AS component_id,
    COALESCE(k.n_links, 0) AS n_links
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
  LEFT JOIN k ON k.a = d.doc_id"""

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents),
  k AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50),
  h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM k),
  f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1),
  g AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS gone
    FROM h JOIN f USING (h) WHERE first < doc_id GROUP BY 1),
  t AS (SELECT doc_id, w, COALESCE(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
  u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
  x AS (SELECT doc_id, unnest(gone) AS p FROM t),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
    FROM u ANTI JOIN x USING (doc_id, p) GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
    sha256(COALESCE(kept.text, '')) AS kept_sha256
  FROM t LEFT JOIN kept USING (doc_id)"""

_DRAW = """list_sort(list_transform(range({n}), lambda i: {{'draw': -ln((('0x' || substr(md5(
  CAST(doc_id AS VARCHAR) || ':' || i), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0),
  'i': i}}))[1].i"""

SHARDING = f"""WITH d AS (SELECT doc_id, strlen(COALESCE(text, '')) + 1 AS size,
    {_crc32('text')} AS text_crc32, CAST({_DRAW.format(n=16)} AS INTEGER) AS shard,
    CAST({_DRAW.format(n=17)} AS INTEGER) AS grown_shard,
    ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents)
  SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1 AS slot
  FROM d"""

EXACT_DEDUP = """SELECT doc_id, max(doc_id) OVER same AS keep_id,
    count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
    sha256(COALESCE(text, '')) AS text_sha256
  FROM documents WINDOW same AS (PARTITION BY COALESCE(text, ''))"""

_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(s, CAST(1 + i // 8 * 10
    AS BIGINT), 10))::BIGINT >> (35 - i % 8 * 5)) & 31) AS BIGINT), 1)), '')"""

WARC = f"""WITH p AS (SELECT page_id, COALESCE(html, '') AS t,
    sha1(COALESCE(html, '')) AS s, min(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first
    FROM pages)
  SELECT page_id, strlen(t) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""

MIXING = f"""WITH RECURSIVE d AS (SELECT doc_id, source,
    len({_words('text')}) AS size, ('0x' || substr(md5('mix:' || doc_id || ':'
      || md5(COALESCE(text, ''))), 1, 15))::BIGINT AS h FROM documents),
  s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
  s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (
      ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
      3.0::DOUBLE * source_size AS cap FROM s0),
  -- the level rises from round to round until no open source is above its cap
  t AS (SELECT 0 AS round, [0]::BIGINT[] AS full, (SELECT sum(source_size)::DOUBLE
      / sum(weight) FROM s1) AS level
    UNION ALL SELECT round + 1, n.full, n.level FROM t, LATERAL (
      SELECT list(rn ORDER BY rn) FILTER (cap <= t.level * weight) AS full,
        (sum(source_size)::DOUBLE - COALESCE(sum(cap) FILTER (cap <= t.level * weight), 0))
          / sum(weight) FILTER (cap > t.level * weight) AS level
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s1)) n
    WHERE round < 100 AND n.level > t.level),
  s AS (SELECT *, CASE WHEN cap <= level * weight THEN cap ELSE level * weight END AS target
    FROM s1, (SELECT max(level) AS level FROM t)),
  v AS (SELECT *, COALESCE(lag(until) OVER (ORDER BY source NULLS LAST), 0) AS since FROM (
    SELECT *, CAST(ceil(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER ()
      * 4294967296.0::DOUBLE) AS BIGINT) AS until FROM s)),
  b AS (SELECT 1 AS block, sum(size)::BIGINT AS total FROM d),
  i AS (SELECT unnest(range(CAST(ceil(total / block::DOUBLE) AS BIGINT))) AS slot FROM b),
  turns AS (SELECT v.source, row_number() OVER (PARTITION BY v.source ORDER BY slot) - 1 AS turn
    FROM (SELECT slot, CAST((slot::HUGEINT * 2654435769 + 2147483648) % 4294967296 AS BIGINT)
      AS point FROM i) JOIN v ON point >= since AND point < until),
  takes AS (SELECT source, turn % blocks AS block, count(*) AS times FROM turns JOIN (
      SELECT source AS z, CAST(ceil(source_size / block::DOUBLE) AS BIGINT) AS blocks FROM s, b)
      ON z IS NOT DISTINCT FROM source WHERE turn < 3 * blocks GROUP BY ALL),
  line AS (SELECT *, COALESCE(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM d),
  spread AS (SELECT doc_id, source, size, first, unnest(range(first // block,
      (first + size - 1) // block + 1)) AS k, block FROM line, b WHERE size > 0),
  got AS (SELECT p.doc_id, sum((least(p.first + p.size, (p.k + 1) * p.block)
      - greatest(p.first, p.k * p.block)) * COALESCE(takes.times, 0))::BIGINT AS taken
    FROM spread p LEFT JOIN takes ON takes.source IS NOT DISTINCT FROM p.source
      AND takes.block = p.k GROUP BY 1)
  SELECT d.doc_id, d.size, s.source_size, s.target, COALESCE(got.taken, 0) AS taken,
    CASE WHEN got.taken > 0 THEN line.first END AS first_slot
  FROM d JOIN line USING (doc_id) JOIN s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN got USING (doc_id)"""

_MARKS = "!#*$%&"
_TAILS = "#*$%&"
_RULES = 11


def _occurrences(text: str, parts: list[str]) -> str:
    return " + ".join(f"(strlen({text}) - strlen(replace({text}, '{part}', ''))) // {len(part)}"
                      for part in parts)


def _low(share: str, good: float, bad: float) -> str:
    return f"CASE WHEN {share} >= {bad}::DOUBLE THEN 0 WHEN {share} <= {good}::DOUBLE THEN 1 ELSE -1 END"


_N = "greatest(n_words, 1)::DOUBLE"
_VOTES = ", ".join([
    "CASE WHEN n_words < 20 THEN 0 WHEN n_words >= 40 THEN 1 ELSE -1 END",
    f"CASE WHEN word_chars / {_N} < 2.5 OR word_chars / {_N} > 12 THEN 0 "
    f"WHEN word_chars / {_N} BETWEEN 3 AND 9 THEN 1 ELSE -1 END",
    _low(f"n_symbols / {_N}", 0.05, 0.2),
    _low("n_dup_lines / greatest(n_lines, 1)::DOUBLE", 0.1, 0.3),
    _low(f"n_repeat_words / {_N}", 0.05, 0.2),
    _low("n_upper / greatest(word_chars, 1)::DOUBLE", 0.1, 0.3),
    _low(f"n_marks / {_N}", 0.1, 0.3),
    _low(f"n_doubled / {_N}", 0.05, 0.2),
    _low(f"n_tails / {_N}", 0.05, 0.2),
    _low(f"n_bars / {_N}", 0.05, 0.2),
    f"CASE WHEN n_distinct / {_N} < 0.15::DOUBLE THEN 0 WHEN n_distinct / {_N} > 0.3::DOUBLE THEN 1 ELSE -1 END",
])
_ODDS = f"""ln(prior / (1 - prior)) + list_sum(list_transform(range(1, {_RULES + 1}),
      lambda j: CASE votes[j] WHEN 1 THEN ln(kg[j] / kb[j])
        WHEN 0 THEN ln((1 - kg[j]) / (1 - kb[j])) ELSE 0::DOUBLE END))"""

# kg and kb: chance of a keep vote given a good and a bad document, per rule
QUALITY_RULES = f"""WITH RECURSIVE t AS (SELECT doc_id, COALESCE(text, '') AS t,
    translate(COALESCE(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') || ' ' AS flat,
    {_words('text')} AS w, list_filter(string_split(COALESCE(text, ''), chr(10)),
      lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
  g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM t WHERE len(w) >= 5),
  h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 4], ' ')) AS n FROM g),
  r AS (SELECT doc_id, len(list_distinct(flatten(list(range(p, p + 5)))))::BIGINT AS n_repeat_words
    FROM h WHERE n > 1 GROUP BY 1),
  c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    COALESCE(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks,
    {_occurrences('t', [m * 2 for m in _MARKS])} AS n_doubled,
    {_occurrences('flat', [m + ' ' for m in _TAILS])} AS n_tails,
    {_occurrences('t', ['|'])} AS n_bars, len(list_distinct(w)) AS n_distinct
    FROM t LEFT JOIN r USING (doc_id)),
  v AS (SELECT *, [{_VOTES}] AS votes FROM c),
  p AS (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY 1),
  em AS (SELECT 0 AS round, 0.85::DOUBLE AS prior, list_transform(range({_RULES}), lambda i: 0.98::DOUBLE) AS kg,
      list_transform(range({_RULES}), lambda i: 0.75::DOUBLE) AS kb
    UNION ALL SELECT round + 1, max(prior), list(good ORDER BY j), list(least(bad, good) ORDER BY j) FROM (
      SELECT round, j, least(0.99::DOUBLE, greatest(0.5::DOUBLE, sum(n * x) / sum(n))) AS prior,
        least(0.999::DOUBLE, greatest(0.001::DOUBLE, (1.96::DOUBLE + COALESCE(sum(n * x) FILTER (votes[j] = 1), 0))
          / (2 + COALESCE(sum(n * x) FILTER (votes[j] >= 0), 0)))) AS good,
        least(0.999::DOUBLE, greatest(0.001::DOUBLE, (1.5::DOUBLE + COALESCE(sum(n * (1 - x)) FILTER (votes[j] = 1), 0))
          / (2 + COALESCE(sum(n * (1 - x)) FILTER (votes[j] >= 0), 0)))) AS bad
      FROM (SELECT round, votes, n, unnest(range(1, {_RULES + 1})) AS j, 1 / (1 + exp(-({_ODDS}))) AS x
        FROM em, p WHERE round < 50) GROUP BY round, j) GROUP BY round),
  fit AS (SELECT * FROM em WHERE round = 50),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 1 / (1 + exp(-({_ODDS}))) >= 0.5 AS kept FROM b, fit"""


_USABLE = ("embedding IS NOT NULL AND len(list_filter(embedding, "
           "lambda c: c IS NULL OR NOT isfinite(c))) = 0")
_DOT = "list_reduce(list_prepend(0::HUGEINT, list_transform(list_zip({a}, {b}), " \
       "lambda z: z[1]::HUGEINT * z[2])), lambda s, z: s + z)::BIGINT"

EXACT_TOPK = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda c:
      CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {_USABLE}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format(a='q.x', b='c.x')} AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

HARD_NEGATIVES = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda c:
      CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x,
      CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
      {_DOT.format(a='a.x', b='c.x')} AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM c.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
      CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
        ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT s.same
      AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
  SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
  FROM n WHERE rank <= 3"""
