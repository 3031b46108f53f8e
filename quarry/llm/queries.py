"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from quarry.llm import chunked_bpe, imatch, language_id, packing, pstable_neardup, rlbwt_dedup, simhash, suffix_tree_lm, superkmer_dedup, weak_quality

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_imatch": imatch.query,
    "op3_chunked_bpe": chunked_bpe.query,
    "op4_rlbwt_dedup": rlbwt_dedup.query,
    "op5_best_fit_packing": packing.query,
    "op6_simhash": simhash.query,
    "op7_superkmer_dedup": superkmer_dedup.query,
    "op8_weak_quality": weak_quality.query,
    "op9_suffix_tree_lm": suffix_tree_lm.query,
    "op10_pstable_neardup": pstable_neardup.query,
}

#: Removes what repeated windows of 200 bytes cover: every window's hash, the runs they cover, the rest as hex.
_BYTES = r"""with t_ as (select doc_id, encode(coalesce(text, '')) as b from documents),
s_ as (select doc_id, octet_length(b) as n, b from t_),
w_ as (select doc_id, unnest(range(1, n - 198)) as s, b from s_ where n >= 200),
h_ as (select doc_id, s, md5(b[s:s + 199]) as h from w_),
hit_ as (select doc_id, s from h_ join (select h from h_ group by h having count(*) > 1) using (h)),
run_ as (select doc_id, s, sum(first) over (partition by doc_id order by s) as r from (select doc_id, s, (s > coalesce(lag(s) over (partition by doc_id order by s) + 200, 0))::int as first from hit_)),
gone_ as (select doc_id, r, min(s) as a, max(s) + 200 as z from run_ group by 1, 2),
cut_ as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 1) as a, a as z from gone_ union all select doc_id, coalesce(max(z), 1), any_value(n) + 1 from s_ left join gone_ using (doc_id) group by doc_id),
kept_ as (select c.doc_id, string_agg(hex(b[c.a:c.z - 1]), '' order by c.a) as kept from cut_ c join s_ using (doc_id) where c.z > c.a group by 1)
select doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from s_ left join (select doc_id, sum(z - a)::bigint as removed, count(*) as spans from gone_ group by 1) using (doc_id) left join kept_ using (doc_id)"""

#: The same for windows of 35 words.
_WORDS = r"""with t_ as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
w_ as (select doc_id, unnest(range(1, len(w) - 33)) as s, w from t_ where len(w) >= 35),
h_ as (select doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) as h from w_),
hit_ as (select doc_id, s from h_ join (select h from h_ group by h having count(*) > 1) using (h)),
gone_ as (select distinct doc_id, unnest(range(s, s + 35)) as p from hit_),
each_ as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from t_),
kept_ as (select e.doc_id, string_agg(x, ' ' order by e.p) as kept, count(*) as n from each_ e left join gone_ g on g.doc_id = e.doc_id and g.p = e.p where g.p is null group by 1)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t_ left join kept_ using (doc_id)"""

#: All pairs of vectors, and what is reachable over links.
_VECTORS = r"""with recursive ok_ as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n_ as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from ok_),
link_ as materialized (select a.vec_id as a, b.vec_id as b from n_ a join n_ b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach_ as (select a, b from link_ union select r.a, l.b from reach_ r join link_ l on l.a = r.b)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id <= coalesce(m, vec_id) as kept
from embeddings left join (select a as vec_id, count(*) as n from link_ group by 1) using (vec_id) left join (select a as vec_id, min(b) as m from reach_ group by 1) using (vec_id)"""

def _fingerprints() -> str:
    """SimHash in SQL: XXH64 (seed 42) of each distinct shingle by its published steps, in 128-bit integers cut to 64 bits."""
    # fixed values: the primes of XXH64
    primes = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
    wide = lambda x: f"{x % (1 << 64)}::uhugeint"
    p1, p2, p3, p4, p5 = map(wide, primes)
    cut = lambda x: f"(({x}) & {wide(-1)})"
    turn = lambda x, r: cut(f"(({x}) << {r}) | (({x}) >> {64 - r})")
    times = lambda x, p: cut(f"({x}) * {p}")
    read = lambda at, n: "('0x' || " + " || ".join(f"substr(b, ({at}) * 2 + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::ubigint::uhugeint"
    mixed = lambda acc, x: times(turn(cut(f"{acc} + {times(x, p2)}"), 31), p1)
    alone = mixed(wide(0), "x")
    each = lambda first, last, step, value: f"list_transform(range({first}, {last}, {step}), lambda s: {value})"
    fold = lambda xs, step, start: f"list_reduce({xs}, lambda a, x: {step}, {start})"
    begin = (42 + primes[0] + primes[1], 42 + primes[1], 42, 42 - primes[0])
    lanes = ", ".join(f"{fold(each('0', 'n // 32 * 32', 32, read(f's + {8 * j}', 8)), mixed('a', 'x'), wide(v))} as v{j}" for j, v in enumerate(begin))
    joined = cut(" + ".join(turn(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    merged = fold("[v0, v1, v2, v3]", cut(f"{times(f'xor(a, {alone})', p1)} + {p4}"), joined)
    eights = fold(each("n // 32 * 32", "n // 8 * 8", 8, read("s", 8)), cut(f"{times(turn(f'xor(a, {alone})', 27), p1)} + {p4}"), "g")
    last_four = times(read("n // 8 * 8", 4), p1)
    four = cut(f"{times(turn(f'xor(g, {last_four})', 23), p2)} + {p3}")
    one = times("x", p5)
    ones = fold(each("n // 4 * 4", "n", 1, read("s", 1)), times(turn(f"xor(a, {one})", 11), p1), "g")
    bits = ", ".join(f"sum((h >> {k}) & 1) as s{k}" for k in range(64))
    told = " + ".join(f"(case when 2 * s{k} > n then {1 << k}::uhugeint else 0 end)" for k in range(64))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""with recursive t_ as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
w_ as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as k from t_ where len(w) > 0),
s_ as (select doc_id, array_to_string(w[k:k + 2], ' ') as s from w_),
d_ as (select s, hex(encode(s)) as b, octet_length(encode(s)) as n from (select distinct s from s_)),
l_ as (select s, b, n, {lanes} from d_),
a_ as (select s, b, n, case when n >= 32 then {merged} else {wide(42 + primes[4])} end + n::uhugeint as g from l_),
b_ as (select s, b, n, {eights} as g from (select * replace ({cut('g')} as g) from a_)),
c_ as (select s, b, n, case when n % 8 >= 4 then {four} else g end as g from b_),
e_ as (select s, {ones} as g from c_),
x_ as (select s, {times('xor(g, g >> 33)', p2)} as g from e_),
y_ as (select s, {times('xor(g, g >> 29)', p3)} as g from x_),
h_ as (select s, xor(g, g >> 32)::ubigint as h from y_),
v_ as (select doc_id, count(*) as n, {bits} from s_ join h_ using (s) group by doc_id),
f_ as (select doc_id, coalesce(fp, 0::ubigint) as fp from t_ left join (select doc_id, ({told})::ubigint as fp from v_) using (doc_id)),
u_ as materialized (select fp, min(doc_id) as id from f_ group by fp),
link_ as materialized (select a.id as a, b.id as b from u_ a join u_ b on bit_count(xor(a.fp, b.fp)) <= 2),
reach_ as (select a, b from link_ union select r.a, l.b from reach_ r join link_ l on l.a = r.b),
least_ as (select a as id, min(b) as component_id from reach_ group by a)
select doc_id, lpad(lower(hex(fp)), 16, '0') as fingerprint, component_id from f_ join u_ using (fp) join least_ using (id)"""


#: The other operators learn models, draw at random or tokenise: their tests hold them against plain versions.
ORACLES: dict[str, str] = {"op4_rlbwt_dedup": _BYTES, "op6_simhash": _fingerprints(), "op7_superkmer_dedup": _WORDS, "op10_pstable_neardup": _VECTORS}
