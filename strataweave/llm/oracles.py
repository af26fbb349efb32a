"""DuckDB SQL for those queries that SQL can express.

Words are what stands between ASCII white space. The exact checks behind the sketches need no
sketch in SQL: shingles are compared as texts.
"""

from __future__ import annotations

from .lines import LEAST_CHARS, LEAST_DOCS
from .quality import BUCKETS, PRIOR, SMOOTH, THRESHOLD, TRUSTED_ROWS, UNIT
from .quotes import ATTRIBUTION, MARK

WS = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text},''), '{WS}'), lambda w: w <> '')"


def _low(text: str) -> str:
    return f"translate(coalesce({text},''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(w: str, n: int = 5) -> str:
    return f"CASE WHEN len({w})>={n} THEN list_transform(range(1, len({w})-{n - 2}), lambda i: array_to_string({w}[i:i+{n - 1}],' ')) WHEN len({w})>0 THEN [array_to_string({w},' ')] ELSE [] END"


OP1 = f"""WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w)-48)) AS a, unnest(list_transform(range(1, len(w)-48), lambda i: md5(array_to_string(w[i:i+49],' ')))) AS h FROM d WHERE len(w)>=50),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY 1),
g AS (SELECT doc_id, list(a) AS starts FROM win JOIN f USING (h) WHERE doc_id > m GROUP BY 1),
c AS (SELECT DISTINCT doc_id, s + k AS p FROM (SELECT doc_id, unnest(starts) AS s FROM g), range(0,50) r(k)),
k AS (SELECT d.doc_id, any_value(len(w)) AS n, count(c.p) AS gone, any_value(w) AS w, list(c.p) FILTER (WHERE c.p IS NOT NULL) AS ps FROM d LEFT JOIN c USING (doc_id) GROUP BY 1),
o AS (SELECT doc_id, n, gone, CASE WHEN gone=0 THEN array_to_string(w,' ') END AS whole FROM k),
kept AS (SELECT d.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w,1) AS p FROM k WHERE gone>0) x JOIN d USING (doc_id) LEFT JOIN c ON c.doc_id=x.doc_id AND c.p=x.p WHERE c.p IS NULL GROUP BY 1)
SELECT o.doc_id, o.n::BIGINT AS n_words, o.gone::BIGINT AS n_removed, sha256(coalesce(o.whole, kept.t, '')) AS kept_sha256 FROM o LEFT JOIN kept USING (doc_id)"""

OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_low("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({_shingles("w")}) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s=b.s AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*shared >= 85*(x.n+y.n-shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a=r.seen),
c AS (SELECT id AS doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n,0)::BIGINT AS n_shingles, component_id, doc_id=component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_TOKENS = r"regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+')"
_BYTES = "list_transform(range(0, strlen(t)), lambda i: ('0x'||substr(hex(encode(t)), 2*i+1, 2))::BIGINT)"

#: CRC-32 from its definition: 8 shift steps a byte over the reflected polynomial.
_STEP = "CASE WHEN (c & 1)=1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP4 = f"""WITH tbl AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, x: {_STEP}) AS v FROM range(0,256) r(b))),
d AS (SELECT doc_id, text, {_words("text")} AS w, {_TOKENS} AS tk FROM documents),
vocab AS (SELECT DISTINCT unnest(tk) AS t FROM d),
h AS (SELECT t, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)+1])), 4294967295) AS h FROM vocab, tbl),
tok AS (SELECT doc_id, p, h FROM (SELECT doc_id, unnest(tk) AS t, generate_subscripts(tk,1) AS p FROM d) JOIN h USING (t)),
g AS (SELECT doc_id, h % {BUCKETS} AS b FROM tok UNION ALL SELECT doc_id, (ph*31 + h) % {BUCKETS} FROM (SELECT doc_id, h, lag(h) OVER (PARTITION BY doc_id ORDER BY p) AS ph FROM tok) WHERE ph IS NOT NULL),
good AS (SELECT doc_id FROM (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) WHERE q=1 LIMIT {TRUSTED_ROWS}),
cnt AS (SELECT b, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)) AS good FROM g GROUP BY 1),
tot AS (SELECT sum(raw) AS ar, sum(good) AS ag FROM cnt),
wt AS (SELECT b, CASE WHEN ag>0 THEN round((ln((good+{PRIOR}*((raw+{SMOOTH})/(ar+{SMOOTH}*{BUCKETS})))/(ag+{PRIOR})) - ln((raw+{SMOOTH})/(ar+{SMOOTH}*{BUCKETS})))*{UNIT})::BIGINT ELSE 0 END AS wt FROM cnt, tot),
sc AS (SELECT doc_id, count(*) AS n_grams, sum(wt)::BIGINT AS ratio_sum FROM g JOIN wt USING (b) GROUP BY 1),
pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w,1) AS p FROM d),
tri AS (SELECT doc_id, p, x||' '||lead(x,1) OVER q||' '||lead(x,2) OVER q AS t FROM pos WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p FROM tri WHERE t IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
cov AS (SELECT doc_id, count(DISTINCT p+k) AS n FROM rep, range(0,3) r(k) GROUP BY 1),
ln AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w,''))::BIGINT AS word_chars, (length(coalesce(text,'')) - length(regexp_replace(coalesce(text,''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
coalesce(dup.n,0)::BIGINT AS n_dup_lines, coalesce(cov.n,0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100*n_repeat_words > 50*n_words AS base_failed FROM base)
SELECT f.*, coalesce(n_grams,0)::BIGINT AS n_grams, coalesce(ratio_sum,0)::BIGINT AS ratio_sum, NOT base_failed AND coalesce(ratio_sum,0) >= {round(THRESHOLD * UNIT)} * coalesce(n_grams,0) AS kept FROM f LEFT JOIN sc USING (doc_id)"""

OP5 = """WITH p AS (SELECT page_id, encode(coalesce(html,'')) AS x FROM pages), h AS (SELECT page_id, octet_length(x)::BIGINT AS payload_bytes, sha256(x) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes>=100 AND page_id<>first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes>=100 AND page_id<>first THEN first END AS refers_to FROM f"""

_ATTRIBUTION = ATTRIBUTION.replace("'", "''")
_NORMAL = lambda t: f"lower(trim(regexp_replace({t}, '[\\s ]+', ' ', 'g')))"
OP7 = f"""WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text,'') AS text, md5(coalesce(role,chr(1))||chr(0)||coalesce(text,'')) AS mid FROM conversations),
l AS (SELECT DISTINCT mid, conv_id, turn, role, text, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM m WHERE regexp_matches(text, '(?m)^[ \t]*>')),
v AS (SELECT *, length(regexp_extract(line, '{MARK}')) - length(replace(regexp_extract(line, '{MARK}'), '>', '')) AS level FROM l),
n AS (SELECT *, lead(level, 1, 0) OVER w AS below, lag(level, 1, -1) OVER w AS above FROM v WINDOW w AS (PARTITION BY mid, conv_id, turn ORDER BY pos)),
b AS (SELECT mid, conv_id, turn, coalesce(trim(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level=0 AND NOT (below>0 AND regexp_matches(line, '{_ATTRIBUTION}'))), ' '||chr(9)||chr(13)||chr(10)), '') AS body FROM n GROUP BY 1,2,3),
own AS (SELECT m.*, coalesce(b.body, m.text) AS body FROM m LEFT JOIN b ON b.mid=m.mid AND b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.turn IS NOT DISTINCT FROM m.turn),
r AS (SELECT *, sum(CASE WHEN level<>above THEN 1 ELSE 0 END) OVER (PARTITION BY mid, conv_id, turn ORDER BY pos) AS run, {_NORMAL(f"regexp_replace(line, '{MARK}', '')")} AS said FROM n),
s AS (SELECT mid, conv_id, turn, level, run, pos, said FROM r WHERE level>0 AND said<>''),
q AS (SELECT DISTINCT mid, conv_id, turn, level, said FROM (SELECT mid, conv_id, turn, level, said FROM s UNION ALL SELECT mid, conv_id, turn, level, string_agg(said, ' ' ORDER BY pos) FROM s GROUP BY mid, conv_id, turn, level, run HAVING count(*)>1)),
u AS (SELECT conv_id, turn, {_NORMAL("x")} AS said FROM (SELECT conv_id, turn, unnest(list_concat(list_concat(string_split_regex(body, '\r?\n'), string_split_regex(body, '\n\\s*\n')), [body])) AS x FROM own WHERE conv_id IN (SELECT conv_id FROM q))),
f AS (SELECT conv_id, said, min(turn) AS original FROM u WHERE said<>'' GROUP BY 1,2),
k AS (SELECT q.*, original FROM q JOIN f ON f.conv_id=q.conv_id AND f.said=q.said AND original<turn),
g AS (SELECT mid, conv_id, turn, level, original, sum(length(said)) AS size, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT mid, conv_id, turn, sum(n)::BIGINT AS n_linked, arg_max(original, row(-level, size, original)) AS quoted_turn FROM g GROUP BY 1,2,3),
a AS (SELECT mid, conv_id, turn, max(level) AS n_levels, count(*) AS n_quoted FROM q GROUP BY 1,2,3),
z AS (SELECT own.conv_id, own.turn, role, body, coalesce(n_levels,0)::BIGINT AS n_levels, coalesce(n_quoted,0)::BIGINT AS n_quoted, coalesce(n_linked,0)::BIGINT AS n_linked, coalesce(quoted_turn, d.turn) AS parent_turn, CASE WHEN quoted_turn IS NOT NULL THEN 'quote' WHEN d.turn IS NOT NULL THEN 'turn' END AS parent_by
FROM own LEFT JOIN a ON a.mid=own.mid AND a.conv_id=own.conv_id AND a.turn=own.turn LEFT JOIN p ON p.mid=own.mid AND p.conv_id=own.conv_id AND p.turn=own.turn LEFT JOIN (SELECT DISTINCT conv_id, turn FROM m) d ON d.conv_id=own.conv_id AND d.turn=own.turn-1),
y AS (SELECT conv_id, turn, max(parent_turn) AS parent FROM z WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1,2),
t(conv_id, turn, root_turn, depth) AS (SELECT conv_id, turn, turn, 0::BIGINT FROM y WHERE parent IS NULL UNION ALL SELECT y.conv_id, y.turn, t.root_turn, t.depth+1 FROM t JOIN y ON y.conv_id=t.conv_id AND y.parent=t.turn)
SELECT z.*, root_turn, depth FROM z LEFT JOIN t ON t.conv_id=z.conv_id AND t.turn=z.turn"""

OP10 = f"""WITH d AS (SELECT doc_id, {_words("lower(text)")} AS w FROM documents), b AS (SELECT item_id, {_words("lower(text)")} AS w FROM benchmark),
sw AS (SELECT DISTINCT len(w) AS k FROM b WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, unnest({_shingles("w")}) AS s FROM d UNION SELECT doc_id, unnest(list_transform(range(1, len(w)-k+2), lambda i: array_to_string(w[i:i+k-1],' '))) FROM d, sw WHERE len(w)>k), bs AS (SELECT DISTINCT item_id, unnest({_shingles("w")}) AS s FROM b), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*)/n AS containment FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 100*count(*) >= 80*n"""

OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256*x::DOUBLE)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label=b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id%50=0 AND a.vec_id<>b.vec_id),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p, ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p ORDER BY s.score DESC, s.b) AS k FROM p JOIN s ON s.a=p.a AND NOT same AND 50*ps<=100*s.score AND 100*s.score<=95*ps)
SELECT a AS anchor_id, p AS positive_id, k::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k<=3"""

_BARE = "trim(line, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"
OP13 = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) AS p FROM documents),
k AS (SELECT *, {_low(_BARE)} AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key)>={LEAST_CHARS} GROUP BY 1 HAVING count(DISTINCT doc_id)>={LEAST_DOCS}),
m AS (SELECT k.*, coalesce(doc_id<f.last, FALSE) AS gone FROM k LEFT JOIN f ON f.key=k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

SQL: dict[str, str] = {
    "op1_substring": OP1,
    "op3_near_duplicates": OP3,
    "op4_quality": OP4,
    "op5_warc": OP5,
    "op7_quotes": OP7,
    "op10_decontaminate": OP10,
    "op12_hard_negatives": OP12,
    "op13_line_dedup": OP13,
}
