"""DuckDB statements that must give the rows of the registered queries."""

from __future__ import annotations

EXACT_DEDUP = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h from documents),
r as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size, row_number() over w = 1 as kept from d
      window w as (partition by h order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size, kept, h as text_sha256 from r
"""


def _weight(parents: str) -> str:
    return f"""(select case when coalesce(n, 0) = 0 or size = 0 then 200.0e0 when extra > 0 then least(200.0e0, greatest(2.0e0, rate * (1 - rate) / extra - 1)) else 200.0e0 end
    from (select *, bad / cast(n as double) as rate, (spread / 1e6 - free * (bad / cast(n as double)) * (1 - bad / cast(n as double))) / (size / 1e6) as extra
      from (select sum(bad) as bad, sum(n) as n, sum(k - 1) as free, sum(spread - floor(bad * bad * 1000000 / cast(n as double))) as spread, sum(n * 1000000 - floor(nn * 1000000 / cast(n as double))) as size from {parents} where n > 0)))"""


def _sums(by: str, table: str) -> str:
    keys = f"{by}, " if by else ""
    return f"select {keys}sum(bad) as bad, sum(n) as n, sum(n * n) as nn, sum(case when n > 0 then 1 else 0 end) as k, sum(case when n > 0 then floor(bad * bad * 1000000 / cast(n as double)) else 0 end) as spread from {table}" + (f" group by {by}" if by else "")


HOST_REPUTATION = rf"""
with l as (select doc_id, max(greatest(case when quality = 0 then 1 when quality is not null then 0 end, case when toxic = 1 then 1 when toxic is not null then 0 end)) as bad from labels group by doc_id),
u as (select page_id, case when contains(coalesce(url, ''), '://') then regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) else '' end as h0,
        case when contains(coalesce(url, ''), '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
p as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
h0 as (select host, coalesce(sum(bad), 0) as bad, count(bad) as n, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as parts from p left join l on page_id = doc_id group by host),
h as (select host, cast(bad as bigint) as bad, n, array_to_string(parts[-2:], '.') as domain, parts[-1] as suffix from h0),
d as ({_sums("suffix, domain", "h")}), s as ({_sums("suffix", "d")}), r as ({_sums("", "s")}),
w as (select {_weight("r")} as ws, {_weight("s")} as wd, {_weight("d")} as wh, (select (coalesce(bad, 0) + 1) / cast(coalesce(n, 0) + 2 as double) from r) as m0),
ms as (select suffix, (bad + ws * m0) / (n + ws) as m from s, w),
md as (select d.domain, (d.bad + wd * ms.m) / (d.n + wd) as m from d join ms on d.suffix = ms.suffix, w),
mh as (select host, (wh * md.m + bad) / (n + wh) as mean, n + wh as size from h join md on h.domain = md.domain, w),
bad as (select host from mh where mean - 1.645e0 * sqrt(mean * (1 - mean) / (size + 1)) > 0.3e0 and host <> ''),
ru as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(verdict, rhost, rpath)),
fit as (select page_id, host, path, rhost || rpath as rule, verdict, row_number() over (partition by page_id, host, path order by length(rhost || rpath) desc) as k
        from (select distinct page_id, host, path from p), ru where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, case when bad.host is null then 'allow' else 'block' end) as verdict
from p left join fit on fit.k = 1 and p.page_id is not distinct from fit.page_id and p.host = fit.host and p.path = fit.path left join bad on p.host = bad.host
"""

LINE_DEDUP = r"""
with l as (select doc_id, no - 1 as no, ls[no] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as no from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
b as (select *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' as blank from l),
f as (select *, row_number() over (partition by blank, line order by doc_id nulls last, no) as k from b),
d as (select row_number() over (order by doc_id nulls last, no) as r, line, length(line) as n from f where not blank and k = 1),
v as (select r, n, line, p, line[:p - 1] || line[p + 1:] as x from (select r, n, line, unnest(range(1, n + 1)) as p from d where n >= 16)),
sub as (select r from (select r, min(r) over (partition by x, p, n) as m from v) where m < r),
ins as (select distinct v.r as a, d.r as b from v join d on v.x = d.line and d.n >= 16),
near as (select r from sub union select greatest(a, b) from ins where a <> b),
w as (select f.doc_id, f.no, case when blank then 'keep' when k > 1 then 'exact' when near.r is not null then 'near' else 'keep' end as verdict
      from f left join d on not f.blank and f.k = 1 and f.line = d.line left join near on near.r = d.r)
select doc_id, count(*) as n_lines, count(case when verdict = 'exact' then 1 end) as n_exact, count(case when verdict = 'near' then 1 end) as n_near,
  coalesce(string_agg(case when verdict <> 'keep' then cast(no as varchar) end, ',' order by no), '') as dropped from w group by doc_id
"""


def secret_sql() -> str:
    """Base spans by splitting at the matches; entropy by counting every window afresh."""
    from .secrets import ACCESS, ASSIGN, KINDS, LEAST_VALUE, Entropy

    e = Entropy()
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def spans(name: str, pattern: str, kind: int, more: str = "true") -> str:
        p = quote(pattern)
        return f"""{name}_f as materialized (select rid, t, regexp_extract_all(t, {p}) as found, string_split_regex(t, {p}) as gaps, regexp_extract_all(t, {p}, {1 if kind == 0 else 0}) as val from d where regexp_matches(t, {p})),
{name} as (select rid, s as start, {kind} as kind, s + length(m) as end_, m, t from (select rid, t, found[i] as m, val[i] as x, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[:i - 1], lambda g: length(g))), 0) as s from (select *, unnest(range(1, len(found) + 1)) as i from {name}_f)) where {more})"""

    ctes = ["d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents)"]
    ctes += [spans("assign", ASSIGN.replace("(?i:", "(?:(?i)"), 0, f"length(x) >= {LEAST_VALUE}"), spans("access", ACCESS, 1), spans("hexa", "[0-9a-f]{24,}", 2)]
    weights = "[" + ", ".join(map(str, e.weights()[1:])) + "]"
    for c in e.classes:
        run = "[" + "".join("\\" + x if x in "-/+=_" else x for x in c.letters) + "]"
        fit = " and ".join(["regexp_matches(m, '[0-9]')", "regexp_matches(m, '[A-Za-z]')", *[f"not regexp_matches(m, {quote(a)})" for a in e.allowed]])
        ctes += [
            spans(f"c_{c.name}", f"{run}{{{e.window},}}", 3, fit),
            f"w_{c.name} as (select rid, start, m, i, list_sum(list_transform(list_distinct(string_split(w, '')), lambda x: {weights}[len(list_filter(string_split(w, ''), lambda y: y = x))])) as s from (select rid, start, m, i, m[i + 1:i + {e.window}] as w from (select *, unnest(range(0, length(m) - {e.window - 1})) as i from c_{c.name})))",
            f"h_{c.name} as (select *, case when i - lag(i) over (partition by rid, start order by i) <= {e.window} then 0 else 1 end as new from w_{c.name} where s <= {e.most(c)})",
            f"e_{c.name} as (select rid, start + min(i) as start, 3 as kind, start + max(i) + {e.window} as end_ from (select *, sum(new) over (partition by rid, start order by i) as island from h_{c.name}) group by rid, start, island)",
        ]
    union = " union ".join(f"select rid, start, kind, end_ from e_{c.name}" for c in e.classes)
    ctes.append("base as (" + " union all ".join(f"select rid, start, kind, end_ from {n}" for n in ("assign", "access", "hexa")) + ")")
    ctes.append(f"every as (select * from base union all ({union}))")
    kinds = "[" + ", ".join(map(quote, KINDS)) + "]"
    text = f"string_agg({kinds}[kind + 1] || ':' || start || ':' || end_, ',' order by start, kind, end_)"
    counts = ", ".join(f"count(case when kind = {i} then 1 end) as n_{k}" for i, k in enumerate(KINDS[:3]))
    return "with " + ",\n".join(ctes) + f"""
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from d left join (select rid, {counts}, {text} as b from base group by rid) x on x.rid = d.rid left join (select rid, {text} as a from every group by rid) y on y.rid = d.rid"""


def shard_sql(n_shards: int = 40, seed: int = 7) -> str:
    """Checksums byte by byte, row numbers by a window, and walks along the permutation's cycles by recursion."""
    from .shards import OVERHEAD, PRIME, round_keys

    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = lambda acc, x: f"xor({acc} >> 8, {table}[(xor({acc}, {x}) & 255) + 1])"
    numbers = "list_transform(regexp_extract_all(h, '..'), lambda x: cast(instr('0123456789ABCDEF', x[1]) * 16 + instr('0123456789ABCDEF', x[2]) - 17 as bigint))"

    def permuted(source: str) -> str:
        sql = f"(select rn, x // b as l, x % b as r, a, b, n from {source})"
        for j, k in enumerate(round_keys(seed)):
            v, w, m = ("r", "l", "a") if j % 2 == 0 else ("l", "r", "b")
            u = f"(({v} + {k}) % {PRIME})"
            f = f"((({u} * {u}) % {PRIME}) * (({u} * {u}) % {PRIME}) % {PRIME}) * {u} % {PRIME}"
            other = "r" if w == "l" else "l"
            sql = f"(select rn, ({w} + {f}) % {m} as {w}, {other}, a, b, n from {sql})"
        return f"select rn, l * b + r as x, a, b, n from {sql}"

    return f"""
with recursive t as (select doc_id, strlen(coalesce(text, '')) + {OVERHEAD} as size, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, size, xor(list_reduce(list_prepend(cast(4294967295 as bigint), {numbers}), lambda acc, x: {step("acc", "x")}), 4294967295) as crc from t),
r as materialized (select *, row_number() over (order by doc_id nulls first, crc, size) - 1 as rn from c),
n as (select n, a, cast(ceil(n / cast(a as double)) as bigint) as b from (select n, case when n > 1 then cast(floor(sqrt(n - 1)) as bigint) + 1 else 1 end as a from (select count(*) as n from documents))),
s as (select rn, rn as x, a, b, n from r, n),
w as ({permuted("s")} union all {permuted("(select * from w where x >= n)")})
select doc_id, size, crc as text_crc32, 'rows' as law, cast(x % {n_shards} as int) as shard, x // {n_shards} as slot, cast(null as int) as grown_shard from r join w on r.rn = w.rn and w.x < w.n"""


_TERM_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""with d as (select row_number() over () as rid, doc_id, {_TERM_LIST} as t from documents),
sizes as (select rid, doc_id, cast(len(t) as bigint) as n from d where len(t) > 0),
totals as (select cast(count(*) as bigint) as nd, cast(sum(n) as bigint) as nt from sizes),
items as (select row_number() over () as q, item_id, {_TERM_LIST} as t from benchmark),
asked as (select q, term, count(*) as times from (select q, unnest(t) as term from items) group by q, term),
tf as (select rid, term, count(*) as tf from (select rid, unnest(t) as term from d) where term in (select term from asked) group by rid, term),
df as (select term, cast(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) as bigint) as w from tf, totals group by term, nd),
part as (select q, tf.rid, times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // nt)))) as part from asked join tf using (term) join df using (term) join sizes on sizes.rid = tf.rid, totals),
scored as (select q, rid, cast(sum(part) as bigint) as score from part group by q, rid having sum(part) > 0),
ranked as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id, rid) as rank from scored join sizes using (rid))
select item_id, cast(rank as int) as rank, doc_id, score from ranked join items using (q) where rank <= 20"""


def _crc32(digits: str) -> str:
    """Unsigned CRC-32 of a string of ASCII characters, as a DuckDB expression."""
    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    codes = f"list_transform(string_split({digits}, ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda acc, x: xor(acc >> 8, {table}[(xor(acc, x) & 255) + 1])), 4294967295)"


PREFIX_TRIE = f"""with o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as o, sha256(concat(length(coalesce(role, '')), ':', role, text)) as k, cast(strlen(coalesce(text, '')) as bigint) as size from conversations where conv_id is not null),
conv as (select c, max(o) as n, c - c % 5 as b, {_crc32("cast(c as varchar)")} % 9 as h from o group by c),
reb as (select conv.c, o.o as p, k, size from conv join o on o.c = conv.b and o.o <= conv.h union all
 select conv.c, least(conv.h, coalesce(base.n, 0)) + o.o - conv.h as p, k, size from conv join o on o.c = conv.c and o.o > conv.h left join conv as base on base.c = conv.b),
pre as (select c, 0 as d, '' as path, cast(0 as bigint) as size, '' as up from conv union all
 select c, p as d, string_agg(k, '') over w as path, size, coalesce(string_agg(k, '') over (partition by c order by p rows between unbounded preceding and 1 preceding), '') as up from reb window w as (partition by c order by p)),
node as (select path, d, min(c) as conv_id, count(*) as n_convs, max(size) as size, min(up) as up from pre group by path, d),
kids as (select up, count(*) as n_children from node where d > 0 group by up),
full_ as (select node.*, coalesce(n_children, 0) as n_children from node left join kids on kids.up = node.path),
sums as (select pre.path as top, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum((f.n_convs - 1) * f.size) as saved from full_ as f join pre on pre.c = f.conv_id and pre.d <= f.d group by pre.path),
ends as (select path, string_agg(cast(c as varchar), ',' order by c) as ids from (select path, c, d, max(d) over (partition by c) as depth from pre) where d = depth group by path)
select f.conv_id, cast(f.d as bigint) as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_ as f join sums as s on s.top = f.path left join ends as e on e.path = f.path left join node as p on f.d > 0 and p.path = f.up"""
