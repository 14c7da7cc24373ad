"""SQL that gives the same rows as the queries, where SQL can over whole tables."""

_LINES = r"""
    s as (select stream_seq, url, content, regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1), '^www\.', '') site from search_documents where content is not null),
    l as (select stream_seq, url, site, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no from s),
    k as (select stream_seq, url, site, line, line_no, replace(lower(regexp_replace(line, '[^\p{L}]+', '', 'g')), 'ß', 'ss') letters from l),
    r as (select site, letters from k where letters <> '' and site <> '' group by 1, 2 having count(distinct url) >= 5)"""

_LEAKS = r"""
    dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
    iw as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
    ig as (select distinct item_id, array_to_string(w[i:i + 8], ' ') g from (select item_id, w, unnest(range(1, len(w) - 7)) i from iw)),
    dg as (select distinct doc_id, array_to_string(w[i:i + 8], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 7)) i from dw)),
    found as (select distinct doc_id, item_id from dg join ig using (g))"""

SQL = {
    "p2_found": f"with {_LINES} select stream_seq, cast(line_no as bigint) line_no from k join r using (site, letters)",
    "p2_cleaned": f"""with {_LINES},
        c as (select stream_seq, coalesce(string_agg(line, chr(10) order by line_no) filter (where r.site is null), '') cleaned from k left join r on k.site = r.site and k.letters = r.letters group by 1)
        select d.stream_seq, d.url, c.cleaned from search_documents d left join c using (stream_seq)""",
    "p8_lengths": """with t as (select distinct source, text from documents where text is not null and not regexp_full_match(text, '[\\s\\x{A0}]*')),
        l as (select source, 'chars' unit, length(text) length from t union all select source, 'bytes', strlen(text) from t),
        c as (select source, unit, length, count(*) n from l group by 1, 2, 3),
        w as (select *, sum(n) over (partition by source, unit order by length desc rows between unbounded preceding and current row) at_risk,
            sum(n) over (partition by source, unit order by length range between 150 preceding and 150 following) - sum(n) over (partition by source, unit order by length range between 3 preceding and 3 following) around from c),
        x as (select *, n / at_risk x, least((around + 0.5) / (300.0 * at_risk + 1.0), 0.5) p0 from w),
        p as (select *, case when x > p0 and n >= 3 then exp(-at_risk * (x * ln(x / p0) + case when x < 1 then (1 - x) * ln((1 - x) / (1 - p0)) else 0 end)) else 1 end p from x),
        r as (select *, row_number() over (partition by source, unit order by p, length) rk, count(*) over (partition by source, unit) tests from p),
        m as (select *, max(case when p <= 0.01 * rk / tests then p end) over (partition by source, unit) most from r)
        select source, unit, cast(length as bigint) length, n, cast(at_risk as bigint) at_risk, round(cast(p as double), 9) p, coalesce(p <= most, false) "limit" from m""",
    "p7_found": f"with {_LEAKS} select doc_id, item_id from found",
    "p6_bounds": "select cast(c as int) capacity, count(distinct doc_id) documents, true filled, cast(0 as bigint) \"over\", cast(0 as bigint) broken from documents, (select unnest([512, 2048, 8192]) c) where text is not null and not regexp_full_match(text, '[\\s\\x{A0}]*') group by c",
    "p7_contained": f"""with {_LEAKS}, i5 as (select distinct item_id, array_to_string(w[i:i + 4], ' ') g from (select item_id, w, unnest(range(1, len(w) - 3)) i from iw)),
        d5 as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from dw where doc_id in (select doc_id from found))),
        n as (select item_id, count(*) n from i5 group by 1), c as (select f.doc_id, f.item_id, count(*) c from found f join i5 using (item_id) join d5 on d5.doc_id = f.doc_id and d5.g = i5.g group by 1, 2)
        select doc_id, item_id, round(c / n, 9) contained from c join n using (item_id)""",
    "p7_items": f"with {_LEAKS} select item_id, suite, lang, (select count(*) from found f where f.item_id = e.item_id) n_documents from eval_items e",
}
