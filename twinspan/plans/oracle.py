"""DuckDB SQL with the rows of the queries, as chains of common table expressions."""

from __future__ import annotations

from twinspan.functions.hashing import BASE_SEEDS, MIX_1, MIX_2
from twinspan.functions.labels import ACCESSIONS
from twinspan.params import LOOKAHEAD, MAX_HASH_WINDOWS, MAX_WINDOW_HASHES, MIN_REGION, MIN_SHARED, NEXT_WINDOWS, Params
from twinspan.sources.bridge import BASES, LETTERS

_WORD = 1 << 64


def _rotations(p: Params, complement: bool) -> str:
    """The XOR of the seeds of bases b0, b1, ... each rotated by its place, by lists of literals indexed by code + 1."""
    terms = []
    for i in range(p.k):
        n = (i if complement else p.k - 1 - i) % 64
        values = [((h << n) | (h >> (64 - n))) % _WORD if n else h for h in (BASE_SEEDS[::-1] if complement else BASE_SEEDS)]
        column = "b" if i == 0 else f"b{i}"
        terms.append(f"[{', '.join(f'{v}::UBIGINT' for v in values)}][{column} + 1]")
    text = terms[0]
    for t in terms[1:]:
        text = f"xor({text}, {t})"
    return text


def _times(h: str, c: int) -> str:
    return f"((({h})::UHUGEINT * {c}::UHUGEINT) % {_WORD}::UHUGEINT)::UBIGINT"


def sequences() -> str:
    return f"""
with recursive src as (
  select source as genome, doc_id, translate(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'), '{LETTERS}', '{BASES}') as bases,
    cast(dense_rank() over (order by source) - 1 as integer) as file_id from documents
)"""


def searched(p: Params, upto: str) -> str:
    """All expressions up to the named one."""
    letters = "A, C, G, T" if p.masked else "A, C, G, T, a, c, g, t"
    listed = "[" + ", ".join(f"'{x}'" for x in letters.split(", ")) + "]"
    leads = ", ".join(f"lead(b, {i}) over w as b{i}" for i in range(1, p.k))
    valid = " and ".join(f"b{i} is not null and b{i} >= 0" for i in range(1, p.k)) or "true"
    need = f"greatest({MIN_SHARED}, cast(ceil(greatest({{0}}, {{1}}) * {p.shared_rate!r}::double) as bigint))"
    parts = {
        "seqs": f"select *, row_number() over (order by file_id, doc_id) - 1 as seq_id, (length(bases) - {p.window}) // {p.stride} + 1 as n_windows from src where length(bases) >= {p.window}",
        "firsts": "select *, cast(coalesce(sum(n_windows) over (order by seq_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_window from seqs",
        "wins": f"select seq_id, file_id, first_window + i as window_id, i as window_idx, i * {p.stride} as start, substring(bases, i * {p.stride} + 1, {p.window}) as win from (select *, unnest(range(0, n_windows)) as i from firsts)",
        "valids": f"select seq_id, file_id, window_id, window_idx, start, length(regexp_replace(win, '[^{''.join(letters.split(', '))}]', '', 'g')) as valid_bases from wins",
        "letters": "select seq_id, unnest(range(0, length(bases))) as pos, unnest(string_split(bases, '')) as letter from seqs",
        "coded": f"select seq_id, pos, case when list_position({listed}, letter) is null then -1 else (list_position({listed}, letter) - 1) % 4 end as b from letters",
        "kmers": f"select seq_id, pos, b{', ' if leads else ''}{leads} from coded window w as (partition by seq_id order by pos)",
        "both_strands": f"select seq_id, pos, least({_rotations(p, False)}, {_rotations(p, True)}) as h from kmers where b >= 0 and {valid}",
        "mix1": f"select seq_id, pos, xor(h, {p.seed}::UBIGINT) as h from both_strands",
        "mix2": f"select seq_id, pos, {_times('xor(h, h >> 33)', MIX_1)} as h from mix1",
        "mix3": f"select seq_id, pos, {_times('xor(h, h >> 33)', MIX_2)} as h from mix2",
        "hashes": f"select seq_id, pos, cast(xor(h, h >> 33) & 4294967295::UBIGINT as bigint) as hash from mix3 where (xor(h, h >> 33) & 4294967295::UBIGINT) < {p.threshold}",
        "firstly": "select v.seq_id, v.window_id, v.window_idx, h.hash, row_number() over (partition by v.window_id order by h.pos) as nth from valids v join hashes h "
        f"on v.seq_id = h.seq_id and h.pos between v.start and v.start + {p.window - p.k} where v.valid_bases >= {p.valid_bases}",
        "postings": f"select distinct seq_id, window_id, window_idx, hash from firstly where nth <= {MAX_WINDOW_HASHES}",
        "sizes": "select window_id, count(*) as n from postings group by window_id",
        "hash_n": "select hash, count(*) as n from postings group by hash",
        "grouped": "select p.hash, window_id, seq_id, window_idx, " + ", ".join(f"lead(window_id, {i}) over w as w{i}, lead(seq_id, {i}) over w as s{i}, lead(window_idx, {i}) over w as i{i}" for i in range(1, NEXT_WINDOWS + 1))
        + f" from postings p join hash_n n on p.hash = n.hash where n.n between 2 and {MAX_HASH_WINDOWS} window w as (partition by p.hash order by window_id)",
        "raw": " union all ".join(f"select hash, window_id as wa, w{i} as wb from grouped where w{i} is not null and (seq_id <> s{i} or abs(window_idx - i{i}) * {p.stride} >= {p.window})" for i in range(1, NEXT_WINDOWS + 1)),
        "cand": "select distinct wa, wb from raw",
        "counted": "select c.wa, c.wb, count(y.hash) as shared from cand c join postings x on x.window_id = c.wa left join postings y on y.window_id = c.wb and y.hash = x.hash group by c.wa, c.wb",
        "sim": f"select c.wa, c.wb, c.shared, (c.shared * 255 + greatest(a.n, b.n) // 2) // greatest(a.n, b.n) as score from counted c join sizes a on a.window_id = c.wa join sizes b on b.window_id = c.wb where c.shared >= {need.format('a.n', 'b.n')}",
        "steps": f"select unnest(list_filter(range(-{LOOKAHEAD}, {LOOKAHEAD + 1}), lambda x: x <> 0)) as d",
        "near": "select s.wa, s.wb, a.window_id + i.d as x, b.window_id + j.d as y, a.seq_id as qa, b.seq_id as qb, a.window_idx + i.d as ia, b.window_idx + j.d as ib "
        "from sim s join valids a on a.window_id = s.wa join valids b on b.window_id = s.wb cross join steps i cross join steps j",
        "grid": f"select n.wa, n.wb, n.x, n.y from near n join valids a on a.window_id = n.x and a.seq_id = n.qa join valids b on b.window_id = n.y and b.seq_id = n.qb where n.qa <> n.qb or abs(n.ia - n.ib) * {p.stride} >= {p.window}",
        "grid_pairs": "select distinct x, y from grid",
        "grid_shared": "select g.x, g.y, count(*) as shared from grid_pairs g join postings a on a.window_id = g.x join postings b on b.window_id = g.y and b.hash = a.hash group by g.x, g.y",
        "grid_ok": f"select s.x, s.y from grid_shared s join sizes a on a.window_id = s.x join sizes b on b.window_id = s.y where s.shared >= {need.format('a.n', 'b.n')}",
        "accepted": "select distinct s.* from sim s join grid g on g.wa = s.wa and g.wb = s.wb join grid_ok o on o.x = g.x and o.y = g.y",
        "flagged": "select wa as window_id from accepted union select wb from accepted",
        "lagged": f"select v.window_id, v.seq_id, v.file_id, v.window_idx, case when v.window_idx - lag(v.window_idx) over (partition by v.seq_id order by v.window_idx) <= {LOOKAHEAD} then 0 else 1 end as starts from flagged f join valids v on v.window_id = f.window_id",
        "members": "select window_id, seq_id, file_id, window_idx, cast(sum(starts) over (order by window_id) - 1 as bigint) as region_id from lagged",
        "regs": f"select region_id, seq_id, file_id, min(window_idx) * {p.stride} as start, max(window_idx) * {p.stride} + {p.window} as \"end\" from members group by region_id, seq_id, file_id",
        "edges": "select a.region_id as ra, b.region_id as rb, e.score from accepted e join members a on a.window_id = e.wa join members b on b.window_id = e.wb",
        "sides": "select ra as region_id, rb as other, score from edges union all select rb, ra, score from edges",
        "best": "select region_id, other as partner_id, score from (select *, row_number() over (partition by region_id order by score desc, other) as nth from sides where region_id <> other) where nth = 1",
        "partners": "select s.region_id, b.partner_id, b.score, b.partner_id is null as is_internal from (select distinct region_id from sides) s left join best b on b.region_id = s.region_id",
        "links": "select region_id as u, partner_id as v from best union select partner_id, region_id from best",
        "reach": "select region_id as node, region_id as root from regs union select l.v, r.root from reach r join links l on l.u = r.node",
        "comps": "select node as region_id, min(root) as component from reach group by node",
        "clustered": "select r.*, c.component, p.is_internal, cast(dense_rank() over (order by c.component) as bigint) as cluster_id from regs r join comps c on c.region_id = r.region_id join partners p on p.region_id = r.region_id",
        "counts": "select *, count(*) over (partition by cluster_id, file_id) as copies from clustered",
        "bed": f"select s.genome || '-' || s.doc_id as chrom, c.start, c.\"end\", cast(c.cluster_id as integer) as cluster_id from counts c join seqs s on s.seq_id = c.seq_id where c.\"end\" - c.start >= {min(p.window, MIN_REGION)}"
        + (f" and (c.copies >= {p.copies}" + (" or (c.copies = 1 and c.is_internal)" if p.copies == 2 else "") + ")" if p.copies > 1 else ""),
    }
    names = list(parts)
    kept = names[: names.index(upto) + 1]
    return sequences() + "".join(f", {n} as {'materialized ' if n in ('postings', 'valids', 'accepted', 'sim', 'grid', 'cand', 'members', 'seqs', 'best') else ''}({parts[n]})" for n in kept)


INTERVALS = """
with lines as (
  select distinct 'chr' || (l_suppkey % 5 + 1) as chrom, l_partkey * 100 + l_linenumber * 7 as start,
    l_partkey * 100 + l_linenumber * 7 + cast(l_quantity as bigint) * 20 as "end", l_linenumber % 2 = 1 as pred from lineitem
), p as (select distinct chrom, start, "end" from lines where pred), r as (select distinct chrom, start, "end" from lines where not pred)"""


def merged(name: str, of: str) -> str:
    return f"""
, {name}_n as (
  select *, case when start <= max("end") over (partition by chrom order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from {of}
), {name}_i as (select *, sum(new) over (partition by chrom order by start, "end" rows unbounded preceding) as island from {name}_n
), {name} as (select chrom, min(start) as start, max("end") as "end" from {name}_i group by chrom, island)"""


def shares(tp: str, matched: str) -> str:
    return f"""case when total_ref > 0 then {tp}::double / total_ref::double else 0.0 end as recall, case when total_pred > 0 then {matched}::double / total_pred::double else 0.0 end as precision"""


BP_METRICS = INTERVALS + merged("pm", "p") + merged("rm", "r") + """
, t as (select (select coalesce(sum("end" - start), 0) from pm)::bigint as pred_bp, (select coalesce(sum("end" - start), 0) from rm)::bigint as ref_bp,
  (select coalesce(sum(least(a."end", b."end") - greatest(a.start, b.start)), 0) from pm a join rm b on a.chrom = b.chrom and a.start < b."end" and b.start < a."end")::bigint as is_bp
), m as (select *, case when ref_bp > 0 then is_bp::double / ref_bp::double else 0.0 end as recall, case when pred_bp > 0 then is_bp::double / pred_bp::double else 0.0 end as precision from t)
select pred_bp, ref_bp, is_bp, pred_bp - is_bp as pred_unique_bp, ref_bp - is_bp as ref_unique_bp, recall, precision,
  case when recall + precision > 0 then 2.0::double * recall * precision / (recall + precision) else 0.0 end as f1,
  case when pred_bp + ref_bp - is_bp > 0 then is_bp::double / (pred_bp + ref_bp - is_bp)::double else 0.0 end as jaccard from m"""

_COVERED = 'select count(*) from {0} a where a."end" > a.start and exists (select 1 from {1} b where a.chrom = b.chrom and b."end" > a.start and greatest(least(a."end", b."end") - greatest(a.start, b.start), 0)::double / (a."end" - a.start)::double >= 0.5)'
_F1 = "case when recall + precision > 0 then 2.0::double * recall * precision / (recall + precision) else 0.0 end as f1, tp, total_pred - matched as fp, total_ref - tp as fn, total_ref, total_pred"

FRAGMENT_METRICS = INTERVALS + f"""
, t as (select (select count(*) from r) as total_ref, (select count(*) from p) as total_pred, ({_COVERED.format('r', 'p')}) as tp, ({_COVERED.format('p', 'r')}) as matched
), m as (select *, {shares('tp', 'matched')} from t)
select recall, precision, {_F1} from m"""

PAIRS = """
with mem as (
  select distinct 'chr' || (l_suppkey % 5 + 1) as chrom, l_partkey * 100 + l_linenumber * 7 as start,
    l_partkey * 100 + l_linenumber * 7 + cast(l_quantity as bigint) * 20 as "end", l_orderkey as cluster_id, l_linenumber % 2 = 1 as pred from lineitem
)"""

CLUSTER_PAIRS = PAIRS + """
, nth as (select distinct cluster_id, chrom, start, "end" from mem), o as (select *, row_number() over (partition by cluster_id order by chrom, start, "end") as n from nth)
select a.cluster_id, a.chrom as c1, a.start as s1, a."end" as e1, b.chrom as c2, b.start as s2, b."end" as e2 from o a join o b on a.cluster_id = b.cluster_id and a.n < b.n
where not (a.chrom = b.chrom and greatest(a.start, b.start) < least(a."end", b."end"))"""

BED9_PAIRS = PAIRS + """
, nth as (select distinct cluster_id, chrom, start, "end" from mem), o as (select *, row_number() over (partition by cluster_id order by chrom, start, "end") as n from nth)
select a.chrom, a.start, a."end", b.chrom || ':' || b.start || '-' || b."end" as name, '0' as score, '+' as strand, a.start as thick_start, a."end" as thick_end, '139,139,139' as rgb
from o a join o b on a.cluster_id = b.cluster_id and a.n <> b.n"""


def _pairs_of(name: str, pred: str) -> str:
    return f"""
, {name}_m as (select distinct cluster_id, chrom, start, "end" from mem where {pred}), {name}_o as (select *, row_number() over (partition by cluster_id order by chrom, start, "end") as n from {name}_m
), {name}_p as (select a.chrom as c1, a.start as s1, a."end" as e1, b.chrom as c2, b.start as s2, b."end" as e2 from {name}_o a join {name}_o b on a.cluster_id = b.cluster_id and a.n < b.n
  where not (a.chrom = b.chrom and greatest(a.start, b.start) < least(a."end", b."end"))
), {name} as (select row_number() over () as id, least(c1, c2) as c1, greatest(c1, c2) as c2, case when c1 <= c2 then s1 else s2 end as s1, case when c1 <= c2 then e1 else e2 end as e1,
  case when c1 <= c2 then s2 else s1 end as s2, case when c1 <= c2 then e2 else e1 end as e2 from {name}_p)"""


def _cover(i: int, j: int) -> str:
    shared = f"greatest(least(r.e{i}, t.e{j}) - greatest(r.s{i}, t.s{j}), 0)::double"
    return f"({shared} / (r.e{i} - r.s{i}) >= 0.5 and {shared} / (t.e{j} - t.s{j}) >= 0.5)"


PAIR_METRICS = PAIRS + _pairs_of("ref", "not pred") + _pairs_of("tgt", "pred") + f"""
, hits as (select r.id as rid, t.id as tid from ref r join tgt t on r.c1 = t.c1 and r.c2 = t.c2 and t.s1 < r.e1 and t.e1 > r.s1
  where r.e1 > r.s1 and r.e2 > r.s2 and t.e1 > t.s1 and t.e2 > t.s2 and (({_cover(1, 1)} and {_cover(2, 2)}) or ({_cover(1, 2)} and {_cover(2, 1)}))
), t as (select (select count(*) from ref) as total_ref, (select count(*) from tgt) as total_pred, (select count(distinct rid) from hits) as tp, (select count(distinct tid) from hits) as matched
), m as (select *, {shares('tp', 'matched')} from t)
select recall, precision, {_F1} from m"""

ACCESSION_CASES = "case label " + " ".join(f"when '{a}' then '{c}'" for a, c in ACCESSIONS.items()) + " else label end"
