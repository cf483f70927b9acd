"""Registered queries of this package, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.llm import cell_codes, codeword_lang, guess_cost, importance_draw, label_shards, page_text, piece_counts, prefix_trie_join, subsequence_svm, template_leaks, url_aliases, wand_search, weighted_mix

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RULES = url_aliases.parse_rules("block net/, allow example.net/en/, block example.com/de/, allow org/fr/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # on a local master Python workers find this package even if it is not installed
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op8_piece_counts")
def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_codeword_lang")
def op9_codeword_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return codeword_lang.identify(documents, codeword_lang.fit(documents))


OP6_SQL = r"""
with recursive parts as (
    select page_id, url, html,
           case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
    from pages),
split as (
    select page_id, url, html, coalesce(rest, '') as rest,
           translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
    from parts),
targets as (
    select host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as a, replace(trim(unnest([
        regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
        regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*[''"]?([^"''\s>]+)', 1, 'is')])), '&amp;', '&') as t,
        rest, url
    from split where rest <> ''),
absolute as (
    select a, case when contains(t, '://') then substr(t, instr(t, '://') + 3)
                   when starts_with(t, '//') then substr(t, 3)
                   when starts_with(t, '/') then regexp_extract(rest, '^[^/?#]*', 0) || t
                   when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then ''
                   else regexp_extract(rest, '^[^/?#]*', 0) || coalesce(nullif(regexp_extract(rest, '^[^/?#]*(/[^?#]*/|/)', 1), ''), '/') || t end as rest
    from targets where t <> '' and not starts_with(t, '#')),
edges as (
    select distinct a, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                       || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as b
    from absolute where rest <> ''),
both_ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
rules(rule, verdict) as (values ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
named as (select distinct b as node, regexp_extract(b, '^[^/?#]*', 0) as host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) as path from reach),
node_rules as (
    select node, arg_max(verdict, length(rule)) as said
    from named join rules on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
                         and starts_with(path, substr(rule, instr(rule, '/')))
    group by node),
alias as (
    select r.a as node, bool_or(said = 'allow') as allowed, bool_or(said = 'block') as blocked
    from reach r left join node_rules n on r.b = n.node group by r.a),
page_rules as (
    select page_id, url, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
    from split join rules on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
                         and starts_with(path, substr(rule, instr(rule, '/')))
    group by page_id, url)
select s.page_id, s.host, s.path, p.rule,
       coalesce(p.verdict, case when coalesce(a.allowed, false) then 'allow' when a.blocked then 'block' else 'allow' end) as verdict,
       case when p.rule is not null then 'rule' when a.blocked and not coalesce(a.allowed, false) then 'alias' else 'default' end as decided_by
from split s left join page_rules p on s.page_id is not distinct from p.page_id and s.url = p.url
left join alias a on a.node = s.host || regexp_extract(s.rest, '^[^/?#]*([^#]*)', 1)
"""


@query("op6_url_aliases", OP6_SQL)
def op6_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.judge(table(spark, sf_dir, "pages"), RULES)


@query("op2_label_shards")
def op2_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.balanced_shards(table(spark, sf_dir, "documents"))


#: A source's domain is its number modulo four.
DOMAINS = {0: "web", 1: "books", 2: "code", 3: "forum"}
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "code": 20, "forum": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}


def source_domain():
    number = F.regexp_extract("source", r"([0-9]+)$", 1)
    out = F.lit("other")
    for k, name in DOMAINS.items():
        out = F.when((number != "") & (number.try_cast("long") % 4 == k), F.lit(name)).otherwise(out)
    return out


def corpus_mix(share: float, epochs: int) -> weighted_mix.Mix:
    return weighted_mix.Mix(source_domain(), DOMAIN_WEIGHTS, LANG_WEIGHTS, share=share, epochs=epochs)


def _fill_sql(nodes: str, parents: str) -> str:
    """SQL of one level: nodes(domain, [lang, [source,]] name, cap, weight, given) -> the same with got."""
    part = f"partition by {parents}" if parents else ""
    return f"""
    select *, case when is_full then cap else shared + case when turn <= over_by then 1 else 0 end end as got
    from (select *, left_over - sum(case when is_full then 0 else shared end) over ({part}) as over_by,
                 row_number() over ({part} order by is_full, name) as turn
          from (select *, case when is_full then cap else (left_over * weight) // weights end as shared
                from (select *, given - sum(case when is_full then cap else 0 end) over ({part}) as left_over,
                             sum(case when is_full then 0 else weight end) over ({part}) as weights
                      from (select *, caps * weight + cap * rest_weight <= given * weight as is_full
                            from (select *, sum(cap) over ({part} order by cap::double / weight::double, name rows unbounded preceding) as caps,
                                         coalesce(sum(weight) over ({part} order by cap::double / weight::double, name rows between 1 following and unbounded following), 0) as rest_weight
                                  from {nodes})))))"""


OP3_SQL = rf"""
with counted as (
    select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
           coalesce(case try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint) % 4
               when 0 then 'web' when 1 then 'books' when 2 then 'code' when 3 then 'forum' end, 'other') as domain,
           len(regexp_extract_all(text, '[^ 	-
]+')) as tokens
    from documents where len(regexp_extract_all(text, '[^ 	-
]+')) > 0),
leaves as (
    select domain, lang, source, sum(tokens)::hugeint as tokens, sum(tokens)::hugeint * 2 as cap,
           case domain when 'web' then 40 when 'books' then 30 when 'code' then 20 when 'forum' then 10 else 1 end::hugeint as w1,
           case lang when 'en' then 50 when 'de' then 20 when 'fr' then 20 when 'es' then 10 else 1 end::hugeint as w2
    from counted group by all),
n1 as (select domain, domain as name, sum(cap)::hugeint as cap, max(w1) as weight,
              (select least(floor(sum(tokens) * 0.9)::hugeint, sum(cap)::hugeint) from leaves) as given
       from leaves group by domain),
g1 as ({_fill_sql('n1', '')}),
n2 as (select l.domain, l.lang, l.lang as name, sum(l.cap)::hugeint as cap, max(w2) as weight, max(got)::hugeint as given
       from leaves l join g1 on l.domain = g1.domain group by l.domain, l.lang),
g2 as ({_fill_sql('n2', 'domain')}),
n3 as (select l.domain, l.lang, l.source, l.source as name, l.cap, 1::hugeint as weight, got::hugeint as given
       from leaves l join g2 on l.domain = g2.domain and l.lang = g2.lang),
g3 as ({_fill_sql('n3', 'domain, lang')}),
budgets as (select l.domain, l.lang, l.source, (got // l.tokens)::int as full_epochs, got % l.tokens as rest
            from g3 join leaves l on g3.domain = l.domain and g3.lang = l.lang and g3.source = l.source where got > 0),
ranked as (
    select c.*, b.full_epochs, b.rest,
           coalesce(sum(c.tokens) over (partition by c.domain, c.lang, c.source
               order by md5('mix:' || b.full_epochs || ':' || coalesce(c.doc_id::varchar, '')), c.doc_id, c.tokens
               rows between unbounded preceding and 1 preceding), 0) as ahead
    from counted c join budgets b on c.domain = b.domain and c.lang = b.lang and c.source = b.source)
select doc_id, domain, lang, source, tokens, epoch::int as epoch, tokens::bigint as taken
from (select *, unnest(range(full_epochs)) as epoch from ranked)
union all
select doc_id, domain, lang, source, tokens, full_epochs::int as epoch, least(tokens, rest - ahead)::bigint as taken
from ranked where rest > ahead
"""


@query("op3_weighted_mix", OP3_SQL)
def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = weighted_mix.select_mix(table(spark, sf_dir, "documents"), corpus_mix(share=0.9, epochs=2))
    return chosen.select("m_doc.doc_id", "domain", "lang", "source", "tokens", "epoch", "taken")


@query("op10_prefix_trie_join")
def op10_prefix_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie_join.similar_groups(table(spark, sf_dir, "documents"))


@query("op5_subsequence_svm")
def op5_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subsequence_svm.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _template_sql(source: str, key: str) -> str:
    """key, raw, and both streams' codes of every text."""
    units = ", ".join(f"'{u}'" for u in template_leaks.UNITS)
    digit = "raw[i][1] between '0' and '9'"
    unit = f"i > 1 and raw[i - 1][1] between '0' and '9' and lower(raw[i]) in ({units})"
    return rf"""
    select {key}, raw, [case
        when {digit} then '#number'
        when lower(raw[i][1]) <> raw[i][1] and raw[i][2] <> '' and lower(raw[i][2]) = raw[i][2] then '#name'
        when {unit} then '#unit'
        else lower(upper(raw[i])) end for i in range(1, len(raw) + 1)] as plain,
      [case when {digit} then '#number' when {unit} then '#unit' else lower(upper(raw[i])) end for i in range(1, len(raw) + 1)] as folded_code
    from (select {key}, regexp_extract_all(text, '(\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*|\p{{L}}[\p{{L}}\p{{M}}''’]*)', 1) as raw
          from {source} where text is not null)"""


def _template_windows_sql(rows: str, key: str) -> str:
    """key, i, folded, win, slots: the windows of five tokens, and the folded ones where a window holds a name."""
    return f"""
    select {key}, i, folded, code[i + 1 : i + 5] as win,
           [case when code[k] in ('#number', '#name', '#unit') then case when folded then lower(raw[k]) else raw[k] end end
            for k in range(i + 1, i + 6)] as slots
    from (select {key}, raw, folded, plain, code, unnest(range(greatest(len(code) - 4, 0))) as i
          from (select {key}, raw, false as folded, plain, plain as code from {rows} union all select {key}, raw, true, plain, folded_code from {rows}))
    where not folded or list_contains(plain[i + 1 : i + 5], '#name')"""


OP4_SQL = f"""
with items as ({_template_sql('benchmark', 'item_id')}),
item_windows as materialized (
    select distinct on (item_id, i, folded, win) item_id, i as pos, folded, win, slots
    from ({_template_windows_sql('items', 'item_id')}) where len([x for x in slots if x is null]) >= 2),
sizes as (
    select item_id, count(distinct pos) filter (where not folded) as windows, count(distinct tok) as tokens
    from (select *, unnest(range(pos, pos + 5)) as tok from item_windows) group by item_id),
known as materialized (select w.*, n.windows, n.tokens from item_windows w join sizes n on w.item_id is not distinct from n.item_id),
docs as ({_template_sql('documents', 'doc_id')}),
doc_windows as (
    select doc_id, i, folded, win, slots as seen from ({_template_windows_sql('docs', 'doc_id')})
    where hash(win) in (select hash(win) from known)),
met as materialized (
    select doc_id, item_id, windows, tokens, d.folded or k.folded as folded, pos, i - pos as shift, seen, slots
    from doc_windows d join known k on d.win = k.win),
pairs as materialized (
    select doc_id, item_id, folded, shift, count(distinct v) as values_, count(distinct o) as others, count(distinct (v, o)) as pairs
    from (select doc_id, item_id, folded, shift, unnest(slots) as v, unnest(seen) as o from met) where v is not null
    group by all),
broken as (select * from pairs where pairs * 0.8 > least(values_, others)),
consistent as materialized (
    select * from met m where not exists (
        select 1 from broken b where b.doc_id is not distinct from m.doc_id and b.item_id is not distinct from m.item_id
                                 and b.shift = m.shift and (m.folded or not b.folded))),
covered as (
    select doc_id, item_id, max(n) / max(tokens) as share_covered
    from (select doc_id, item_id, half, stretch, max(tokens) as tokens, count(distinct tok) as n
          from (select doc_id, item_id, tokens, half, floor(shift / tokens + half / 2) as stretch, unnest(range(pos, pos + 5)) as tok
                from (select *, unnest([0, 1]) as half from consistent)) group by all)
    group by doc_id, item_id),
found as (
    select doc_id, item_id, count(distinct pos) filter (where not folded) as matched, max(windows) as windows
    from consistent group by doc_id, item_id),
kept as (select doc_id, item_id, max(values_) as slots, max(case when pairs * 0.8 <= least(values_, others) then values_ end) as slots_kept
         from pairs where not folded group by doc_id, item_id)
select f.doc_id, f.item_id, matched, windows, case when windows > 0 then matched / windows else 0.0 end as share_matched,
       coalesce(slots, 0) as slots, coalesce(slots_kept, 0) as slots_kept
from found f
join covered c on f.doc_id is not distinct from c.doc_id and f.item_id is not distinct from c.item_id
left join kept k on f.doc_id is not distinct from k.doc_id and f.item_id is not distinct from k.item_id
where (windows > 0 and matched >= 0.8 * windows) or share_covered >= 0.6
"""


@query("op4_template_leaks", OP4_SQL)
def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("share_covered")


@query("op1_page_text")
def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(table(spark, sf_dir, "pages"))


@query("op7_wand_search")
def op7_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return wand_search.top_matches(documents, documents.where("doc_id % 50 = 0"))


def _cell_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assigning and averaging over (vector, part, place) rows; for tables of one vector length."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
    select v, part, arg_min(entry, gap * {entries} + entry) as entry, min(gap) as gap
    from (select c.v, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) as gap
          from comps c join b{r} b on c.part = b.part and c.place = b.place group by c.v, c.part, b.entry)
    group by v, part)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} as materialized (
    select b.part, b.entry, b.place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x)::bigint as x
    from b{r} b left join (
        select a.part, a.entry, c.place, sum(c.x)::hugeint as s, count(*)::hugeint as n
        from a{r} a join comps c on a.v = c.v and a.part = c.part group by all) m
    on b.part = m.part and b.entry = m.entry and b.place = m.place)""")
    return f"""
with kept as materialized (
    select row_number() over (order by vec_id, embedding) as v, vec_id, label, embedding from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
flat as (select v, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i, len(embedding) // {parts} as width from kept),
comps as materialized (select v, (i // width)::int as part, (i % width)::int as place, floor(1024 * x)::bigint as x from flat),
b0 as materialized (select part, (v - 1)::int as entry, place, x from comps where v <= {entries}),
{",".join(steps)},
coded as (
    select v, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(gap)::bigint as error from a{rounds} group by v),
labelled as (select k.vec_id, k.label, c.code, c.error from coded c join kept k on c.v = k.v),
totals as (select label, sum(error)::bigint as label_error from labelled group by label)
select l.vec_id, l.code, l.error, t.label_error,
       (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) from b{rounds}) as codebooks_sha256
from labelled l join totals t on l.label is not distinct from t.label
"""


@query("op11_cell_codes", _cell_codes_sql())
def op11_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def _runs_sql(source: str) -> str:
    return rf"""
    select *, unnest(words) as word from (
        select *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from {source})"""


#: crc32 of each distinct word, byte by byte from its UTF-8 bytes in hexadecimal.
OP12_SQL = f"""
with crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c
        from (select unnest(range(256)) as i))),
numbered as (select row_number() over () as row_id, doc_id, text from documents),
doc_words as materialized (select row_id, doc_id, len(words) as n, word from ({_runs_sql('numbered')})),
item_words as materialized (select word from ({_runs_sql('benchmark')})),
spelled as (
    select word, hex(encode(word)) as h from (select word from doc_words union select word from item_words)),
bucketed as materialized (
    select word, xor(list_reduce(
        list_prepend(4294967295, [('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint for i in range(len(h) // 2)]),
        lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 10000 as bucket
    from spelled, crc_table),
s as (select bucket, count(*) as s from doc_words join bucketed using (word) group by bucket),
t as (select bucket, count(*) as t from item_words join bucketed using (word) group by bucket),
totals as (select (select count(*) from doc_words) as ss, (select count(*) from item_words) as tt),
gains as (
    select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + 10000)::double / ((coalesce(s, 0) + 1)::double * (tt + 10000)::double)))::bigint as gain
    from (select distinct bucket from bucketed) left join s using (bucket) left join t using (bucket), totals),
weights as (
    select row_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight
    from doc_words join bucketed using (word) join gains using (bucket) group by row_id),
scored as (
    select d.row_id, d.doc_id, coalesce(w.n, 0) as n_features, coalesce(w.weight, 0) as weight,
           coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
    from numbered d left join weights w using (row_id)),
eligible as (select *, row_number() over (order by score desc, doc_id) as turn, count(*) over () as total from scored where n_features >= 20)
select s.doc_id, s.n_features::bigint as n_features, s.weight, s.score,
       case when e.turn <= e.total * 10 // 100 then e.turn end::bigint as rank
from scored s left join eligible e using (row_id)
"""


@query("op12_importance_draw", OP12_SQL)
def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_draw.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_guess_cost")
def op13_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guess_cost.secrets(table(spark, sf_dir, "documents"))
