"""DuckDB statements for the corpus queries that SQL can express."""

ORACLE: dict[str, str] = {
    "op1_line_dedup": """
with lines as (
  select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
  from documents where text is not null
), flagged as (
  select trim(line) as body, min(doc_id) as home from lines where trim(line) <> ''
  group by 1 having count(distinct source) >= 8
), marked as (
  select l.doc_id, l.pos, l.line, f.body is not null and f.home <> l.doc_id as gone
  from lines l left join flagged f on trim(l.line) = f.body
), clean as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as body
  from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(body, '')) as kept_sha256
from documents d left join clean using (doc_id)
""",
    "op6_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
), scored as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 5
""",
    "op10_substring_dedup": """
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as body
  from words, unnest(range(1, len(w) - 11)) as r(i)
), firsts as (
  select body, min(doc_id) as first_id from windows group by body
), gone as (
  select distinct doc_id, p from windows join firsts using (body), unnest(range(i, i + 13)) as r(p) where first_id < doc_id
), each_word as (
  select doc_id, p, w[p] as word from words, unnest(range(1, len(w) + 1)) as r(p)
), kept as (
  select e.doc_id, string_agg(word, ' ' order by p) as body, count(*) as n
  from each_word e anti join gone g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from words left join kept using (doc_id)
""",
    "op11_url_filters": """
with parts as (
  select row_number() over () as no, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)([^#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)([^#]*)', 2) as path,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)([^#]*)', 3) as query
  from pages
), tokens as (
  select no, page_id, unnest(list_distinct(list_concat(
           list_transform(regexp_extract_all(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: 'h:' || x),
           list_transform(regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: 'p:' || x),
           list_transform(regexp_extract_all(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: 'q:' || x)))) as token
  from parts
), marks as (
  select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels group by 1
), labelled as (
  select no, bad from parts join marks using (page_id)
), size as (
  select count(*) as n_all, sum(bad) as n_bad, greatest(5, ceil(0.002 * count(*))) as least from labelled
), frequent as (
  select token, count(*) as n from tokens join labelled using (no), size where length(token) <= 64
  group by token, least having count(*) >= least
), items as (
  select no, token, bad from tokens join labelled using (no) join frequent using (token)
  qualify row_number() over (partition by no order by n, token) <= 12
), sets as (
  select [token] as rule, count(*) as n, sum(bad) as hits from items group by all
  union all
  select [a.token, b.token], count(*), sum(a.bad) from items a join items b on a.no = b.no and a.token < b.token group by all
  union all
  select [a.token, b.token, c.token], count(*), sum(a.bad)
  from items a join items b on a.no = b.no and a.token < b.token join items c on b.no = c.no and b.token < c.token group by all
), mined as (
  select rule from sets, size
  where hits >= least and hits >= 0.5 * n
    and (hits / n + 6.635776 / (2 * n) - 2.576 * sqrt(hits / n * (1 - hits / n) / n + 6.635776 / (4 * n * n))) / (1 + 6.635776 / n) > n_bad / n_all
), caught as (
  select no from mined, unnest(rule) as t(token) join tokens using (token) group by no, rule having count(*) = len(rule)
), judged as (
  select no, page_id, host, path,
         case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
              when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
              when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
              when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parts
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when no in (select no from caught) then 'block' else 'allow' end as verdict
from judged
""",
    "op12_importance_resampling": """
with recursive crc(n, c, k) as (
  select i, i, 0 from range(256) r(i)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8
), crc_table as (
  select list(c order by n) as t from crc where k = 8
), texts as (
  select 0 as side, row_number() over () as no, doc_id, text from documents
  union all
  select 1, row_number() over (), null, text from benchmark
), worded as (
  select side, no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts
), features as (
  select side, no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from worded
), counted as (
  select side, no, f, count(*) as n from features group by all
), coded as (
  select f, hex(encode(f)) as x, t from (select distinct f from counted), crc_table
), bucketed as (
  select f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint),
                            lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), 4294967295), 4294967295) % 10000 as bucket
  from coded
), totals as (
  select bucket, coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t
  from counted join bucketed using (f) group by bucket
), gains as (
  select bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000)))) as gain
  from totals, (select sum(s) as s_all, sum(t) as t_all from totals)
), weights as (
  select no, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight
  from counted join bucketed using (f) join gains using (bucket) where side = 0 group by no
), scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from worded left join weights using (no) where side = 0
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank
from scored left join ranked using (doc_id)
""",
    "op13_ranked_search": """
with terms as (
  select row_number() over () as no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from documents
), counted as (
  select *, sum(tf) over (partition by no)::bigint as n from (select no, doc_id, term, count(*) as tf from terms group by no, doc_id, term)
), totals as (
  select count(distinct no) as docs, sum(tf)::bigint as length from counted
), weighed as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counted, totals group by term, docs
), asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark
), scored as (
  select item_id, no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::bigint as score
  from asked join weighed using (term) join counted using (term), totals group by item_id, no, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select * from ranked where rank <= 10
""",
}
