"""The operators in SQL for DuckDB, for those that SQL can express. Tests and driver compare both."""

from __future__ import annotations

from meterglass.llm import license_scan, mixing, quality_rules
from meterglass.llm.chat_format import END, SEP, START

W = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    bits = " + ".join(f"(CASE WHEN {sql} THEN {1 << bit} ELSE 0 END)" for bit, sql in enumerate(quality_rules.RULES.values()))
    policy = quality_rules.mask(*quality_rules.POLICIES["web"].rules)
    base = quality_rules.mask(*quality_rules.BASE)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{W}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - 1))) AS i FROM w)),
two AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM two, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, length(regexp_replace(t, '[^\pL]', '', 'g')) AS n_letters,
  length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT *, failed & {base} <> 0 AS base_failed, failed & {policy} = 0 AS kept FROM f"""


EXACT = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""


def mixing_sql(mix: mixing.Mixture = mixing.Mixture()) -> str:
    """The exponent by two plain bisections, the prefix of a block by one running sum per source."""
    grid = mixing.GRID
    raised = f"pow(share, CAST({{at}} AS DOUBLE) / {grid})"
    exact = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(38, 18))) AS DOUBLE)"

    def entropy(at: str) -> str:
        p = raised.format(at=at)
        return f"(SELECT ln({exact(p)}) - CAST({at} AS DOUBLE) / {grid} * {exact(f'{p} * ln(share)')} / {exact(p)} FROM tot)"

    def repeats(at: str) -> str:
        p = raised.format(at=at)
        return f"(SELECT {mix.budget} * max({p} / share) / {exact(p)} FROM tot)"

    def bisect(name: str, ok: str) -> str:
        return f"""{name}(lo, hi) AS (SELECT 0, {grid} UNION ALL SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, {ok} AS ok FROM {name} WHERE hi - lo > 1))"""

    p = "pow(share, CAST((SELECT j FROM e) AS DOUBLE) / " + f"{grid})"
    key = f"md5('{mix.seed}:' || full_blocks || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    return f"""WITH RECURSIVE c AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{W}')) AS BIGINT) AS n_tokens FROM documents),
tot AS (SELECT *, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS share FROM (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM c GROUP BY source) WHERE tokens > 0),
{bisect("by_h", f"{entropy('((lo + hi) // 2)')} >= {mix.entropy} * {entropy('0')}")},
{bisect("by_r", f"{repeats('((lo + hi) // 2)')} > {mix.max_repeats}")},
e AS (SELECT greatest(CASE WHEN {entropy(str(grid))} >= {mix.entropy} * {entropy("0")} THEN {grid} ELSE (SELECT max(lo) FROM by_h) END,
  CASE WHEN {repeats("0")} <= {mix.max_repeats} THEN 0 ELSE (SELECT max(lo) + 1 FROM by_r) END) AS j),
plan AS (SELECT *, target // tokens AS full_blocks, target % tokens AS rest FROM (SELECT *, CAST(floor(weight * ({mix.budget} * (SELECT sum(tokens) FROM tot))) AS BIGINT) AS target
  FROM (SELECT *, {p} / (SELECT {exact(p)} FROM tot) AS weight FROM tot))),
placed AS (SELECT c.*, weight, full_blocks, rest, sum(n_tokens) OVER (PARTITION BY c.source ORDER BY {key}) AS upto
  FROM c JOIN plan ON c.source IS NOT DISTINCT FROM plan.source),
taken AS (SELECT *, unnest(range(full_blocks + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS block FROM placed)
SELECT doc_id, source, n_tokens, CAST(block AS BIGINT) AS block, md5('{mix.seed}:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key, round(weight, 9) AS weight FROM taken"""


def license_sql() -> str:
    """Every place of a rare word proposes a start; words and starts are rows."""
    rows, required = [], []
    for k, t in enumerate(license_scan.TEMPLATES):
        rows += [f"({k}, '{t.label}', {str(t.base).lower()}, {i}, '{w}', {len(t.words)})" for i, w in enumerate(t.words)]
        required += [f"({k}, {i}, '{w}')" for i, w in t.required()]
    rare = license_scan.RARE
    return rf"""WITH tw(k, label, base, pos, word, n) AS (VALUES {", ".join(rows)}), req(k, pos, word) AS (VALUES {", ".join(required)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license_scan.WORDS}') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
known AS (SELECT p.* FROM p SEMI JOIN tw USING (word)),
idf AS (SELECT word, CAST(round(ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) * 1e6) AS BIGINT) AS v FROM (SELECT DISTINCT word FROM tw) LEFT JOIN (SELECT word, count(DISTINCT r) AS n FROM known GROUP BY word) USING (word)),
ranked AS (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY v DESC, word) AS place FROM (SELECT DISTINCT k, word FROM tw) JOIN idf USING (word)),
post AS (SELECT tw.*, greatest(1, v) AS v FROM tw JOIN idf USING (word) JOIN ranked USING (k, word) WHERE place <= least({rare}, greatest(1, n // 2))),
cand AS (SELECT DISTINCT known.r, post.k, known.i - post.pos AS s FROM known JOIN post USING (word)),
scored AS (SELECT c.r, c.k, c.s, sum(post.v) FILTER (known.i IS NOT NULL) AS held, sum(post.v) AS whole FROM cand c JOIN post USING (k) LEFT JOIN known ON known.r = c.r AND known.i = c.s + post.pos AND known.word = post.word GROUP BY ALL),
missing AS (SELECT DISTINCT c.r, c.k, c.s FROM cand c JOIN req USING (k) LEFT JOIN known ON known.r = c.r AND known.i = c.s + req.pos AND known.word = req.word WHERE known.i IS NULL),
hit AS (SELECT s.*, t.label, t.base FROM scored s ANTI JOIN missing USING (r, k, s) JOIN (SELECT DISTINCT k, label, base FROM tw) t USING (k) WHERE held >= ceil({license_scan.LEAST} * whole)),
agg AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(held / CAST(whole AS DOUBLE)) AS score FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN agg USING (r)"""


def chat_sql() -> str:
    def escaped(x: str) -> str:
        return rf"regexp_replace(replace({x}, '\', '\\'), '([<\[])(\||/?s>|/?<SYS>>|/SYS>>|/?INST\])', '\1\\\2', 'g')"

    marks = len(START) + len(SEP) + len(END)
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum({marks} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


def trie_sql() -> str:
    """Nodes are whole lists of turns, and every node meets all that lie above it; CRC-32 bit by bit."""
    step = "xor(crc >> 1, (crc & 1) * 3988292384)"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), lambda ch: [ascii(ch)::BIGINT] || [-1::BIGINT, -1, -1, -1, -1, -1, -1]))), lambda crc, b: {y}), 4294967295)"
    # A byte comes in with its first step, seven steps of -1 follow.
    one = f"(CASE WHEN b >= 0 THEN {step.replace('crc', 'xor(crc, b)')} ELSE {step} END)"
    h = crc.format(x="CAST(conv_id AS VARCHAR)", y=one)
    return rf"""WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) AS ts FROM conversations GROUP BY conv_id),
hs AS (SELECT *, {h} % 9 AS h FROM t),
r AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM hs c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM r),
g AS (SELECT depth, ts[1:depth] AS k, count(*) AS n_convs, min(conv_id) AS conv_id, coalesce(strlen(any_value(ts)[depth].t), 0) AS n_bytes,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len(ts)), '')) AS ends_sha256 FROM p GROUP BY depth, k),
u AS (SELECT a.*, p.conv_id AS parent_conv_id FROM g a LEFT JOIN g p ON p.depth = a.depth - 1 AND p.k = a.k[1:a.depth - 1]),
kids AS (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids USING (depth, k)),
up AS (SELECT depth, k, n_convs, n_bytes, n_children, unnest(range(depth + 1)) AS lvl FROM full_),
s AS (SELECT lvl AS depth, k[1:lvl] AS k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * n_bytes) AS BIGINT) AS saved_tokens FROM up GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN s USING (depth, k)"""


TOP_K = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.r != c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5"""


ORACLES = {
    "op1_quality_rules": quality_rules_sql(),
    "op3_source_mixing": mixing_sql(),
    "op4_license_scan": license_sql(),
    "op6_chat_format": chat_sql(),
    "op7_exact_dedup": EXACT,
    "op12_prefix_trie": trie_sql(),
    "op13_pivot_search": TOP_K,
}
