"""DuckDB twins of the queries that SQL can tell at a bearable cost."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

# A path is the hashes of its turns, 32 characters each.
OP11 = f"""
with turns as (
  select conv_id, turn, text, md5(concat(length(role)::varchar, ':', role, ':', text)) as hash
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
words as (select hash, any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) as words from turns group by hash),
own as (
  select conv_id, list(hash order by turn nulls first, hash) as hashes, {CRC32.format("conv_id::varchar")} % 4 as h
  from turns group by conv_id),
paths as (
  select a.conv_id, array_to_string(list_concat(coalesce(b.hashes, [])[1:a.h], a.hashes[a.h + 1:]), '') as path
  from own a left join own b on b.conv_id = a.conv_id - a.conv_id % 20),
members as (select conv_id, path, d, left(path, 32 * d) as node from (select *, unnest(range(length(path) // 32 + 1)) as d from paths)),
nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (path = node), '') as ends
  from members group by node, d),
valued as (
  select nodes.*, coalesce((n - 1) * words, 0) as own_saved, kids.kids
  from nodes left join words on hash = right(node, 32)
  left join (select left(node, 32 * (d - 1)) as node, count(*) as kids from nodes where d > 0 group by 1) kids using (node)),
below as (
  select left(node, 32 * up) as node, sum(own_saved)::bigint as saved_tokens, count(*) filter (kids is null) as n_leaves
  from (select *, unnest(range(d + 1)) as up from valued) group by 1)
select v.conv_id, v.d as depth, p.conv_id as parent_conv_id, v.n as n_convs, coalesce(v.kids, 0) as n_children,
       n_leaves, saved_tokens, sha256(v.ends) as ends_sha256
from valued v join below using (node) left join nodes p on v.d > 0 and p.node = left(v.node, 32 * (v.d - 1))
"""

OP12 = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, piece, regexp_extract_all(text, '[^\\x20\\x09]+') as w
  from (select lang, doc_id, unnest(pieces) as text, generate_subscripts(pieces, 1) as piece
        from (select lang, doc_id, string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') as pieces from documents))),
placed as (select *, coalesce(sum(len(w)) over (partition by lang, doc_id order by piece rows between unbounded preceding and 1 preceding), 0) as before from pieces),
runs as (
  select lang, doc_id, before + i - 1 as word, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select *, unnest(range(1, len(w) - k + 2)) as i from placed, (select unnest(range(1, 6)) as k))),
grams as (select lang, k, phrase, count(*) as f, min((doc_id, word)) as place from runs group by lang, k, phrase),
totals as (select lang, sum(f)::hugeint as n from grams where k = 1 group by lang),
several as (select *, string_split(phrase, ' ') as w from grams where k >= 2 and f >= 100),
cuts as (
  select s.lang, s.phrase, s.f as a, cut, x.f as l, y.f as r, n, 1000::hugeint * s.f * n // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, k)) as cut from several) s
  join grams x on x.lang = s.lang and x.k = cut and x.phrase = array_to_string(s.w[1:cut], ' ')
  join grams y on y.lang = s.lang and y.k = s.k - cut and y.phrase = array_to_string(s.w[cut + 1:], ' ')
  join totals t on t.lang = s.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, array_to_string(w[i:i + size - 1], ' ') as phrase, max(f) as longer
  from (select *, unnest(range(1, k - size + 2)) as i from (select *, unnest(range(2, k)) as size from several)) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank
  from best b left join longer o using (lang, phrase) where longer is null or longer < a)
select r.lang, rank, r.phrase, a, l, r.r, n::bigint as n, score::bigint as score, place[1] as first_doc_id, place[2]::bigint as first_word
from ranked r join several using (lang, phrase) where rank <= 2000
"""

OP13 = """
with docs as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select row, i, array_to_string(w[i:i + 34], ' ') as key from (select row, w, unnest(range(1, len(w) - 33)) as i from docs)),
recurring as (select row, i from (select row, i, count(*) over (partition by key) as n from windows) where n > 1),
removed as (select distinct row, i from (select row, unnest(range(i, i + 35)) as i from recurring)),
words as (select row, unnest(w) as word, generate_subscripts(w, 1) as i from docs),
kept as (select row, count(*) as n, string_agg(word, ' ' order by i) as text from words anti join removed using (row, i) group by row)
select doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (row)
"""
