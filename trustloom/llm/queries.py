"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .bpe import op2_bpe
from .decontaminate import op8_decontaminate
from .html_text import op12_html_text
from .language_id import op9_language_id
from .lexical import SQL as LEXICAL_SQL
from .lexical import op11_lexical
from .line_dedup import op6_line_dedup
from .merkle import SQL as MERKLE_SQL
from .merkle import op13_merkle
from .projected_knn import op10_projected_knn
from .recompression import op7_recompression
from .simhash import op5_simhash
from .suffix_dedup import op4_suffix_dedup
from .url_filter import op1_url_filter
from .warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_bpe, op3_warc, op4_suffix_dedup, op5_simhash, op6_line_dedup, op7_recompression, op8_decontaminate, op9_language_id, op10_projected_knn, op11_lexical, op12_html_text, op13_merkle)}

SQL: dict[str, str] = {
    "op3_warc": r"""with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select html, min(page_id) as first from p group by 1)
select p.page_id, cast(strlen(p.html) as bigint) as payload_bytes,
array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(p.h, cast(j // 4 * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (j % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
case when p.page_id = f.first then 'response' else 'revisit' end as record_type, case when p.page_id <> f.first then f.first end as refers_to,
case when regexp_matches(p.url, '^[^:/?#]*://') then array_to_string(list_reverse(string_split(lower(regexp_extract(p.url, '^[^:/?#]*://([^/?#]*)', 1)), '.')), ',') || ')' || case when regexp_extract(p.url, '^[^:/?#]*://[^/?#]*([^#]*)', 1) = '' then '/' else regexp_extract(p.url, '^[^:/?#]*://[^/?#]*([^#]*)', 1) end else '' end as urlkey,
strftime(to_timestamp(1704067200 + p.page_id % 1000000000) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as ts
from p join f on f.html = p.html""",
    "op7_recompression": r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 34], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 34)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from win) where n > 1),
gone as (select distinct doc_id, unnest(generate_series(i, i + 34)) as p from rep),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d),
kept as (select word.doc_id, count(gone.p) as n_removed, string_agg(x, ' ' order by word.p) filter (gone.p is null) as t from word left join gone on gone.doc_id = word.doc_id and gone.p = word.p group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from d left join kept k on k.doc_id = d.doc_id""",
    "op11_lexical": LEXICAL_SQL,
    "op13_merkle": MERKLE_SQL,
}
