"""The registered queries of the corpus operators and their SQL twins."""

import public_tokenizers

from . import decontaminate, max_plus, merkle, minhash, ngram_filter, pii, quality, ranked_search, run_dedup, simhash, token_files
from . import tool_calls, url_filter
from .common import table

PII_KEY = b"a key for these tables only; give your own"
PIECES = "piece_bpe_32k.model"
TOKENIZER = "byte_bpe_50k.json"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_tool_calls(spark, sf_dir):
    return tool_calls.digest(table(spark, sf_dir, "conversations"))


def op2_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_max_plus_pieces(spark, sf_dir):
    return max_plus.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_run_index_dedup(spark, sf_dir):
    return run_dedup.digest(table(spark, sf_dir, "documents"))


def op6_pii_pseudonyms(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"), PII_KEY)


def op7_ngram_filter(spark, sf_dir):
    return ngram_filter.score_texts(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 2)


def op10_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op11_merkle_manifest(spark, sf_dir):
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_minhash(spark, sf_dir):
    return minhash.digest(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark, sf_dir):
    return ranked_search.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_tool_calls, op2_simhash, op3_quality_rules, op4_max_plus_pieces, op5_run_index_dedup, op6_pii_pseudonyms,
    op7_ngram_filter, op8_benchmark_decontamination, op9_token_files, op10_url_filter, op11_merkle_manifest,
    op12_minhash, op13_ranked_search)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PROMPT = "case when prompt is null then '{' else '{\"prompt\":' || to_json(prompt) || ',' end || '\"turn\":' || turn || '}'"

_LEAF = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))

ORACLE = {
    "op11_merkle_manifest": f"""
        with recursive crc_table as (
            select list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
                        order by i) as t
            from range(256) as r(i)),
        leaves as (
            select doc_id, lang, sha256({_LEAF.format(n="n_chars")}) as leaf,
                   case when xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint),
                                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
                        then sha256({_LEAF.format(n="(n_chars + 1)")}) end as forged
            from documents, crc_table),
        placed as (
            select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as lo, count(*) over (partition by lang) as n
            from leaves),
        nodes as (
            select lang, 0 as level, lo as pos, n, leaf as h from placed
            union all
            select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos))
            from nodes where n > 1 group by lang, level, pos // 2, n),
        subroots as (
            select lang, h, row_number() over (order by lang nulls first) - 1 as lo, count(*) over () as n
            from nodes where n = 1),
        top as (
            select 0 as level, lo as pos, n, h from subroots
            union all
            select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by level, pos // 2, n),
        depth as (select lang, max(level) as levels from nodes group by lang),
        steps as (
            select p.doc_id, p.leaf, k.level as step, n.h, p.lo >> k.level & 1 = 1 as is_left
            from placed p join depth d on p.lang is not distinct from d.lang, range(d.levels) as k(level)
            left join nodes n on n.lang is not distinct from p.lang and n.level = k.level and n.pos = xor(p.lo >> k.level, 1)
            union all
            select p.doc_id, p.leaf, d.levels + k.level, t.h, s.lo >> k.level & 1 = 1
            from placed p join depth d on p.lang is not distinct from d.lang join subroots s on p.lang is not distinct from s.lang,
                 range((select max(level) from top)) as k(level)
            left join top t on t.level = k.level and t.pos = xor(s.lo >> k.level, 1)),
        paths as (
            select doc_id, leaf, list({{'h': coalesce(h, ''), 'is_left': is_left}} order by step) as path from steps group by doc_id, leaf),
        folded as (
            select p.doc_id, p.leaf, p.lang, sha256(coalesce(list_reduce([''] || list_transform(path, lambda s: s.h), lambda a, b: a || b), '')) as proof,
                   list_reduce([{{'h': coalesce(forged, p.leaf), 'is_left': false}}] || coalesce(path, []), lambda a, s: {{
                       'h': sha256(case when s.is_left then s.h || a.h else a.h || s.h end), 'is_left': false}}).h as folded_root
            from placed p left join paths q on p.doc_id is not distinct from q.doc_id and p.leaf = q.leaf)
        select doc_id, leaf, s.h as subroot, (select h from top where n = 1) as root, proof as proof_sha256, folded_root,
               folded_root = (select h from top where n = 1) as verified
        from folded f join subroots s on f.lang is not distinct from s.lang""",
    "op12_minhash": rf"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
        grams as (
            select distinct doc_id, array_to_string(w[i:i + 1], ' ') as g
            from words, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as u(i) where len(w) > 0),
        sets as (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as h from grams group by doc_id),
        classes as (select h, n, min(doc_id) as node from sets group by h, n),
        own as (select node, n, g from grams join classes on doc_id = node),
        links as (
            select a.node as a, b.node as b from own a join own b on a.g = b.g and a.node <> b.node
            where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach as (select node, node as other from classes union select node, b from reach join links on a = other),
        roots as (select node, min(other) as root from reach group by node)
        select doc_id, coalesce(n, 0) as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept
        from words left join sets using (doc_id) left join classes using (h, n) left join roots using (node)""",
    "op13_ranked_search": rf"""
        with terms as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as t from documents),
        asked as (
            select item_id, t, count(*) as times
            from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from benchmark) group by item_id, t),
        sizes as (select count(*) filter (len(t) > 0) as n_docs, sum(len(t))::bigint as n_terms from terms),
        lengths as (select doc_id, 100 - 75 + (75 * len(t)::bigint * n_docs) // n_terms as m from terms, sizes),
        postings as (
            select doc_id, t, count(*) as tf from (select doc_id, unnest(t) as t from terms) where t in (select t from asked) group by doc_id, t),
        weights as (select t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from postings, sizes group by t, n_docs),
        scores as (
            select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
            from asked join postings using (t) join weights using (t) join lengths using (doc_id) group by item_id, doc_id)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
        from scores where score > 0 qualify rank <= 10""",
    "op1_tool_calls": f"""
        with recursive calls as (
            select conv_id, turn, conv_id || '-' || turn as call_id, min(text) as prompt, count(*) as n_calls,
                   case when turn < 2 then 'answer' when turn % 4 < 3 then 'continue' else 'follow' end as name
            from conversations where role = 'user' group by conv_id, turn),
        results as (
            select conv_id, turn, conv_id || '-' || (turn - 1) as call_id, min(text) as content, count(*) as n_results
            from conversations where role = 'assistant' group by conv_id, turn),
        chain as (
            select c.conv_id, c.turn, 0 as level from calls c
            where not exists (select 1 from calls b where b.conv_id = c.conv_id and b.turn = c.turn - 2)
            union all
            select c.conv_id, c.turn, chain.level + 1 from chain join calls c on c.conv_id = chain.conv_id and c.turn = chain.turn + 2),
        linked as (
            select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, level,
                   coalesce(c.turn, r.turn) as turn, name, coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results,
                   prompt, content, c.call_id is null as orphan,
                   case when c.call_id is null or name = 'follow' then null
                        when prompt is null then '$.prompt: missing'
                        when length(prompt) < 1 or name = 'answer' and length(prompt) > 400 then '$.prompt: wrong length'
                        when name = 'continue' and c.turn > 5 then '$.turn: out of range' end as error
            from (select * from calls join chain using (conv_id, turn)) c full join results r using (conv_id, call_id))
        select conv_id, call_id, level, turn, name, n_calls, n_results,
               case when orphan then 'orphan_result' when name = 'follow' then 'unknown_tool'
                    when error is not null then 'invalid_arguments' when n_results = 0 then 'missing_result' else 'ok' end as status,
               error,
               '{{"arguments":' || case when orphan then '{{}}' else {_PROMPT} end || ',"conversation":' || conv_id
               || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name), 'null')
               || ',"result":' || coalesce(to_json(content), 'null') || '}}' as record
        from linked""",
    "op10_url_filter": f"""
        with rest as (
            select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r
            from pages),
        parts as (
            select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
            from rest),
        rules(h, p, v) as (values {', '.join(str(r) for r in RULES)}),
        urls as (select distinct host, path from parts),
        best as (
            select host, path, arg_max(h || p, (length(h || p), h || p)) as rule, arg_max(v, (length(h || p), h || p)) as v
            from urls join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p)
            group by all)
        select page_id, host, path, rule, coalesce(v, 'allow') as verdict
        from parts left join best using (host, path)""",
    "op8_benchmark_decontamination": rf"""
        with words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        items as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        windows as (
            select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as t
            from items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as u(i) where len(w) > 0),
        grams as (
            select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as t
            from words, (select distinct n from windows) as l, unnest(range(1, len(w) - n + 2)) as u(i)),
        hits as (select doc_id, i, n, item_id from grams join windows using (n, t)),
        covered as (select doc_id, count(distinct j) as n_hit from hits, unnest(range(i, i + n)) as u(j) group by doc_id),
        named as (
            select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
            from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from words left join covered using (doc_id) left join named using (doc_id)""",
}
