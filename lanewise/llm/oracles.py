"""DuckDB SQL for the operators that it can express."""
from lanewise.llm.chat_parts import END, TURN

SQL: dict[str, str] = {}

SQL["op11_merkle_exchange"] = """
WITH RECURSIVE parts AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
         replace(text, chr(10), '') AS cut,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
             lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN crc % 2 = 0 THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS found
  FROM parts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
low(tree, level, idx, n, node) AS (
  SELECT tree, 0, idx, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 3, n),
subroots AS (SELECT tree, node AS subroot FROM low WHERE n = 1),
high(level, idx, n, node) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 3, n),
steps AS (
  SELECT p.tree, p.idx, 0 AS part, l.level, coalesce(string_agg(l.node, '' ORDER BY l.idx) FILTER (l.idx < p.idx // pow(3, l.level)::BIGINT), '') AS near,
         coalesce(string_agg(l.node, '' ORDER BY l.idx) FILTER (l.idx > p.idx // pow(3, l.level)::BIGINT), '') AS far
  FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.idx // 3 = p.idx // pow(3, l.level + 1)::BIGINT GROUP BY ALL
  UNION ALL
  SELECT p.tree, p.idx, 1, h.level, coalesce(string_agg(h.node, '' ORDER BY h.idx) FILTER (h.idx < p.tree // pow(3, h.level)::BIGINT), ''),
         coalesce(string_agg(h.node, '' ORDER BY h.idx) FILTER (h.idx > p.tree // pow(3, h.level)::BIGINT), '')
  FROM placed p JOIN high h ON h.n > 1 AND h.idx // 3 = p.tree // pow(3, h.level + 1)::BIGINT GROUP BY ALL),
proofs AS (SELECT tree, idx, list(near || '|' || far ORDER BY part, level) AS proof FROM steps GROUP BY ALL),
folded AS (
  SELECT p.*, r.subroot, (SELECT node FROM high WHERE n = 1) AS root, coalesce(f.proof, []::VARCHAR[]) AS proof,
         list_reduce(list_concat([p.found], coalesce(f.proof, []::VARCHAR[])),
                     lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM placed p JOIN subroots r USING (tree) LEFT JOIN proofs f USING (tree, idx))
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

SQL["op12_chat_parts"] = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
marked AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n') AS shown_role,
         replace(replace(text, '\', '\\'), '<', '\<') AS shown_text, role = 'assistant' AS learned FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (learned), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (learned), '')) AS loss_sha256,
       sum({len(TURN) + 1 + len(END)} + length(shown_role) + length(shown_text))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def _codes() -> str:
    """Each round is a step of its own: distances of all parts to all entries, then means rounded down."""
    def nearest(book: str) -> str:
        # distances are whole numbers below 2**53, so doubles hold them; the smallest distance, then the smallest entry
        return f"""SELECT vec_id, label, part, v, min(({DISTANCE})::BIGINT * 256 + entry) AS best FROM parts JOIN {book} USING (part) GROUP BY ALL"""

    steps = ["""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "parts AS MATERIALIZED (SELECT vec_id, label, part, v[1 + part * len(v) // 4:(part + 1) * len(v) // 4] AS v FROM kept, range(4) r(part))",
             """seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256)""",
             "book0 AS MATERIALIZED (SELECT part, entry, v AS c FROM parts JOIN seeds USING (vec_id))"]
    for k in range(4):
        steps += [f"near{k} AS MATERIALIZED ({nearest(f'book{k}')})",
                  f"""sums{k} AS (
  SELECT part, best % 256 AS entry, i, sum(v[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT part, best, v, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY ALL)""",
                  f"""means{k} AS (SELECT part, entry, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM sums{k} GROUP BY ALL)""",
                  f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m, c) AS c FROM book{k} b LEFT JOIN means{k} m USING (part, entry))"]
    return f"""WITH {", ".join(steps)}, last AS ({nearest("book4")}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM last GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) FROM book4) AS codebooks_sha256
FROM coded"""


DISTANCE = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
SQL["op13_vector_codes"] = _codes()
