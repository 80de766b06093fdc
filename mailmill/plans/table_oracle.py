"""The same queries as plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

from ..categories import CATEGORIES, IGNORED_LABELS
from ..functions.text import WHITESPACE
from ..operators.scoring import DEFAULT_RULES, word_pattern
from .table_queries import _LIMITS, TABLE_RULES

_SPACE = "'" + WHITESPACE + "'"


def _sql_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_IGNORED = _sql_list(IGNORED_LABELS)

MAIL = """
mail0 as (
  select d.*, l.quality, l.toxic, l.doc_id is not null as reviewed,
         case when coalesce(l.toxic, 0) = 0 then
           case when n_chars < 800 then 'ADS' when n_chars < 1500 then 'JOB_OPPORTUNITIES'
                when n_chars < 3000 then 'OTHERS' else 'BANK_STATEMENTS' end end as category,
         timestamp '2024-01-01' + to_minutes(d.doc_id) as internal_ts
  from documents d left join labels l on d.doc_id = l.doc_id
),
mail as (
  select cast(doc_id as varchar) as id,
         strftime(internal_ts + interval 330 minute, '%Y-%m-%dT%H:%M:%S') || '+05:30' as date,
         internal_ts, source as sender, split_part(text, chr(10), 1) as subject,
         text as body_text,
         [x for x in [
           case when source <> 'src0' then 'INBOX' end,
           case when source = 'src0' then 'SENT' end,
           case when quality is null then 'UNREAD' end,
           case when source in ('src3', 'src7') then 'CATEGORY_PROMOTIONS' end,
           case when source = 'src5' then 'CATEGORY_UPDATES' end,
           case when lang = 'es' then 'CATEGORY_PERSONAL' end,
           case when quality = 1 then 'Label_q1' end,
           case when toxic = 1 then 'Label_t1' end,
           case when category = 'ADS' and quality = 1 then 'Label_c1' end,
           case when category = 'OTHERS' and quality = 1 then 'Label_c2' end,
           case when category = 'ADS' and quality = 0 then 'Label_c3' end,
           'Label_' || lang] if x is not null] as label_ids,
         category, case when category is not null then 'size ' || n_chars end as reason,
         doc_id, lang, source, n_chars, quality, toxic, reviewed,
         source <> 'src0' as is_inbox, quality is null as is_unread,
         lang = 'es' or source not in ('src3', 'src7', 'src5') as is_primary
  from mail0
)"""

LABEL_DIM = """
held as (select doc_id, id, unnest(label_ids) as label_id from mail),
label_dim as (
  select label_id, min(doc_id) as scan_order,
         case when label_id in ('Label_c1', 'Label_c3') then 'ADS'
              when label_id = 'Label_c2' then 'OTHERS'
              when label_id = 'Label_q1' then 'GOOD'
              when label_id like 'Label\\_%' escape '\\' then 'LANG_' || upper(substr(label_id, 7))
              else label_id end as label_name
  from held where label_id <> 'Label_t1' group by label_id
),
named as (
  select h.doc_id, h.id, h.label_id, coalesce(d.label_name, h.label_id) as label
  from held h left join label_dim d on h.label_id = d.label_id
),
category_label as (
  select label_name as category, max_by(label_id, scan_order) as label_id
  from label_dim group by label_name
)"""

# Ranks follow the order in which the view puts the labels.
NAMED_LISTS = """
position as (select doc_id, unnest(label_ids) as label_id, generate_subscripts(label_ids, 1) as pos from mail),
named_lists as (
  select n.doc_id, n.id, list(n.label order by p.pos) as labels
  from named n join position p on n.doc_id = p.doc_id and n.label_id = p.label_id
  group by n.doc_id, n.id
)"""

TRUTH = """
truth as (
  select cast(doc_id as varchar) as id,
         case when quality = 1 then ' good ' when toxic = 0 then 'BAD' end as main_label,
         'quality ' || quality as reason
  from labels
),
predicted as (
  select id, case when n_chars > 1500 then 'good' when n_chars < 500 then 'BAD' end as main_label
  from mail
),
compared as (
  select p.id, p.main_label as old_label, t.main_label as new_label
  from predicted p join truth t on p.id = t.id
)"""

_TRIM = f"trim(%s, {_SPACE})"


def _squeeze(text: str) -> str:
    return _TRIM % f"regexp_replace({text}, '[{WHITESPACE}]+\n', chr(10), 'g')"


def _page_text(html: str) -> str:
    hidden = "".join(
        f"|<{tag}[^>]*>.*?</{tag}>" for tag in ("script", "style", "template")
    )
    nodes = (
        f"string_split(regexp_replace({html}, '(?is)<!--.*?-->{hidden}|<[!/?a-z][^>]*>', chr(1), 'g'), chr(1))"
    )
    shown = "x"
    for found, put in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&copy;", "'©'"),
                       ("&middot;", "'·'"), ("&nbsp;", "chr(160)")):
        shown = f"replace({shown}, '{found}', {put})"
    shown = f"regexp_replace({shown}, '&amp(;|$)', '&', 'g')"
    shown = _TRIM % shown
    return f"array_to_string([y for y in [{shown} for x in {nodes}] if y <> ''], ' ')"


def _rule_case(text: str, rules) -> str:
    whens = " ".join(
        f"when regexp_matches({text}, '{word_pattern(words)}') then '{name}'" for name, words in rules
    )
    return f"case {whens} else 'OTHERS' end"


def _rule_scores(rules) -> str:
    text = "lower(subject || chr(10) || body_text)"
    return f"""scores as (
      select *, case when new_category = 'OTHERS' then 'no rule matched'
                     else 'words of ' || new_category end as new_reason
      from (select *, {_rule_case(text, rules)} as new_category from mail)
    )"""


def _report(source: str, column: str) -> str:
    return f"""counts as (select {column} as category, count(*) as n from {source}
                 where {column} is not null group by 1),
    totals as (select max(n) as most, cast(sum(n) as double) as everything from counts)
    select category, n, 100.0::double * n / everything as share_pct,
           repeat('█', cast(ceil(n * 60::double / most) as bigint)) as bar
    from counts, totals"""


def _with(*parts: str, then: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n" + then


_SCOPES = {
    "anywhere": "true",
    "inbox": "is_inbox",
    "unread": "is_inbox and is_unread",
    "unread_primary": "is_inbox and is_unread and is_primary",
}

SPLIT = """
hashed as (select *, lang as truth, md5(id || '-42') as hash from mail),
split as (
  select *, case when row_number() over (order by hash, id) <= floor(0.75 * count(*) over ())
                 then 'train' else 'val' end as split
  from hashed
)"""


def _sample(by: str, n: int) -> str:
    return f"""ranked as (
      select *, row_number() over (partition by {by} order by md5(id || '-42'), id) as place
      from mail where {by} is not null
    ),
    sampled as (select * from ranked where place <= {n})"""


JUDGED = """
judged as (
  select m.id, m.n_chars, upper(trim(t.main_label)) as truth
  from mail m join truth t on m.id = t.id where t.main_label is not null
),
results as (
  select candidate_id, count(*) as n, count(*) filter (right_one) as n_correct,
         100.0::double * count(*) filter (right_one) / count(*) as accuracy_pct
  from (select candidate_id,
               truth = case when n_chars > over_chars then 'GOOD' else 'BAD' end as right_one
        from judged, (values %s) c(candidate_id, over_chars))
  group by candidate_id
)""" % ", ".join(f"('{name}', {limit})" for name, limit in _LIMITS.items())

ACTIONS = """
actions as (
  select m.id, m.category, c.label_id,
         case when m.category is null or c.label_id is null then 'skipped' else 'pending' end as outcome,
         case when m.category is null then 'no category' when c.label_id is null then 'no label' end as skip_reason
  from mail m left join category_label c on m.category = c.category
)"""

_WORDS = "regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+')"
_WHOLE = "subject || chr(10) || body_text"


def _bayes(train: str, test: str, text: str = _WHOLE, test_text: str = "", name: str = "") -> str:
    """CTE `guesses{name}` (id, category): Bayes models of `train` (fold, id, category, ...) on `test` (fold, id, ...).

    The model of a fold is that of the training rows of all other folds.
    """
    def tokens(source: str, of: str, columns: str) -> str:
        return f"select {columns}, unnest({_WORDS % of}) as word from {source}"

    log = "cast(round(ln({}) * 1000000000) as bigint)"
    return f"""
      fold{name} as (select distinct fold from {test}),
      count{name} as (
        select f.fold, category, word, count(*) as n
        from ({tokens(train, text, "fold, category")}) t join fold{name} f on t.fold <> f.fold group by all),
      class{name} as (
        select f.fold, category, count(*) as messages from {train} t join fold{name} f on t.fold <> f.fold group by all),
      vocabulary{name} as (select distinct fold, word from count{name}),
      weight{name} as (
        select c.fold, c.category, {log.format("messages / sum(messages) over (partition by c.fold)")} as share,
               {log.format("cast(coalesce(w.words, 0) + v.size as double)")} as size
        from class{name} c
        left join (select fold, category, sum(n) as words from count{name} group by all) w using (fold, category)
        join (select fold, count(*) as size from vocabulary{name} group by fold) v using (fold)),
      token{name} as (
        select fold, id, word, count(*) as k
        from ({tokens(test, test_text or text, "fold, id")}) group by all),
      seen{name} as (
        select id, sum(k) as seen from token{name} join vocabulary{name} using (fold, word) group by id),
      gain{name} as (
        select id, category, sum(k * {log.format("cast(n + 1 as double)")}) as gain
        from token{name} join count{name} using (fold, word) group by all),
      guesses{name} as (
        select t.id, arg_min(w.category, (-(w.share + coalesce(g.gain, 0) - coalesce(s.seen, 0) * w.size), w.category)) as category
        from {test} t join weight{name} w using (fold)
        left join gain{name} g on g.id = t.id and g.category = w.category
        left join seen{name} s on s.id = t.id group by t.id)"""


def _folds(source: str, folds: int) -> str:
    return f"""select *, cast(floor((row_number() over (order by md5(id || '-42'), id) - 1) * {folds} / count(*) over ()) as int) as fold
               from {source}"""


_ML = (
    MAIL, SPLIT,
    "train as (select 1 as fold, id, lang as category, subject, body_text from split where split = 'train')",
    "val as (select 0 as fold, id, subject, body_text, lang as truth from split where split = 'val')",
    _bayes("train", "val"),
)

_LABEL_TEXT = "array_to_string(labels, ',')"
_ID_TEXT = "array_to_string(label_ids, ',')"


def _scorer_accuracy() -> str:
    text = "lower(subject || chr(10) || body_text)"
    short = _rule_case(text, (("de", ("und",)), ("fr", ("dans",))))
    long = _rule_case(
        text, (("de", ("und", "der")), ("fr", ("dans", "pour")), ("es", ("los", "del")))
    )
    return _with(MAIL, then=f"""
      select candidate_id, count(*) as n, count(*) filter (guess = lang) as n_correct,
             100.0::double * count(*) filter (guess = lang) / count(*) as accuracy_pct
      from (select 'few words' as candidate_id, lang, {short} as guess from mail
            union all select 'more words', lang, {long} from mail) group by candidate_id""")


def _registered_best() -> str:
    text = "lower(subject || chr(10) || body_text)"
    few = _rule_case(text, (("de", ("und",)), ("fr", ("dans",))))
    many = _rule_case(text, (("de", ("und", "der")), ("fr", ("dans", "pour")), ("es", ("los", "del"))))
    return _with(MAIL, f"""
      told as (select 'few words' as candidate_id, id, lang, {few} as category from mail
               union all select 'more words', id, lang, {many} from mail),
      best as (select candidate_id from told group by candidate_id
               order by count(*) filter (category = lang) desc, candidate_id limit 1)""",
        then="select candidate_id, id, category from told where candidate_id = (select candidate_id from best)")


_RESPONSE_OK = "coalesce(toxic, 0) = 0 and lang not in ('fr', 'de') and n_chars >= 700"

_PROMPT = "'Subject: ' || subject || chr(10) || 'Body: ' || body_text"

_MAIN_IGNORED = _sql_list((*IGNORED_LABELS, "Label_en", "Label_fr"))

# Unread mail as the jobs read it from landing files, sorted by the rules of their queries.
_JOB = (
    MAIL, LABEL_DIM, "bodies as (select *, lower(subject || chr(10) || "
    + _squeeze("concat_ws(chr(10), nullif(body_text, ''), nullif(" + _page_text("html") + ", ''))")
    + ") as words from mail left join pages on page_id = doc_id where is_inbox and is_unread)",
    "streamed as (select id, is_primary, "
    + _rule_case("words", (("ADS", ("und", "der")), ("BANK_STATEMENTS", ("pour", "dans"))))
    + " as category from bodies)",
)

ORACLE = {
    "unread_report": _with(
        MAIL, _rule_scores(TABLE_RULES), "unread as (select * from scores where is_inbox and is_unread)",
        then=", " + _report("unread", "new_category"),
    ),
    **{
        f"scope_{name}": _with(MAIL, then=f"select id, date, sender, subject from mail where {test}")
        for name, test in _SCOPES.items()
    },
    "scope_flags": _with(MAIL, then="""
      select id, cast(is_inbox as int) as is_inbox, cast(is_unread as int) as is_unread,
             cast(is_primary as int) as is_primary from mail"""),
    "required_labels": _with(MAIL, then="select id, date from mail where is_inbox and quality = 1"),
    "custom_labelled": _with(MAIL, then="""
      select id, date from mail
      where quality = 1 or (category = 'ADS' and reviewed)"""),
    "recent_top_n": _with(MAIL, then="""
      select id, date, subject from mail order by internal_ts desc, id limit 100"""),
    "recent_in_one_second": _with(MAIL, then="""
      select id, subject from mail order by doc_id % 4 desc, id limit 300"""),
    "first_rows": _with(MAIL, then="select id, sender from mail order by sender, id limit 20"),
    "sender_contains": _with(MAIL, then="""
      select id, sender from mail where regexp_matches(sender, 'rc1[0-4]?$')"""),
    "latest_per_id": _with(MAIL, then="""
      select id, case when reviewed then 'Re: ' || subject else subject end as subject,
             case when reviewed then 2 + quality else 1 end as came from mail"""),
    "sample_columns": _with(MAIL, then="""
      select id, subject, category, reason from mail where category is not null"""),
    "tidied_truth": _with(MAIL, TRUTH, then="select id, main_label as category from truth"),
    "label_names_mapped": _with(MAIL, LABEL_DIM, NAMED_LISTS, then=f"""
      select id, {_LABEL_TEXT} as labels from named_lists"""),
    "label_names_joined": _with(MAIL, LABEL_DIM, NAMED_LISTS, then=f"""
      select id, {_LABEL_TEXT} as labels from named_lists"""),
    "label_names_skewed": _with(MAIL, LABEL_DIM, NAMED_LISTS, then=f"""
      select m.id, case when m.doc_id % 10 = 0 then array_to_string(list_concat(n.labels, ['own_' || m.id, (select label_name from label_dim where label_id = 'INBOX')]), ',')
                        else 'INBOX,LANG_EN,ADS' end as labels
      from mail m join named_lists n on m.id = n.id"""),
    "label_coverage": _with(
        MAIL, LABEL_DIM,
        "categories(rank, category) as (values "
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES, 1)) + ")",
        then="""
      select rank, c.category, cast(l.label_id is not null as int) as present,
             count(l.label_id) over () || '/' || count(*) over () as covered
      from categories c left join category_label l on c.category = l.category"""),
    "label_message_counts": _with(MAIL, LABEL_DIM, then=f"""
      select label, count(distinct id) as n from named where label not in {_IGNORED} group by label"""),
    "ignored_label_counts": _with(MAIL, LABEL_DIM, then="""
      select i.label, count(distinct n.id) as n
      from (select unnest([%s]) as label) i left join named n on i.label = n.label
      group by i.label""" % _IGNORED.strip("()")),
    "distinct_labels": _with(MAIL, LABEL_DIM, then="select distinct label from named"),
    "tag_label_set": _with(MAIL, LABEL_DIM, then=f"""
      select distinct label from named where label not in {_IGNORED}"""),
    "custom_labels_in_use": _with(MAIL, LABEL_DIM, then="""
      select label_id as label from held
      intersect select label_id from label_dim where starts_with(label_id, 'Label_')"""),
    "categories_of_both": _with(MAIL, TRUTH, then="""
      select main_label from truth union select main_label from predicted"""),
    "labels_per_message": _with(MAIL, LABEL_DIM, then=f"""
      select tags, count(*) as n from (
        select id, count(*) filter (label not in {_IGNORED}) as tags from named group by id)
      group by tags"""),
    "main_labels": _with(MAIL, then=f"""
      select id, array_to_string(tags, ',') as tags, coalesce(tags[1], '') as main_label
      from (select id, [x for x in label_ids if x not in {_MAIN_IGNORED}] as tags from mail)"""),
    "main_label_counts": _with(MAIL, LABEL_DIM, NAMED_LISTS, then=f"""
      select coalesce([x for x in labels if x not in {_IGNORED}][1], '') as main_label, count(*) as n
      from named_lists group by 1"""),
    "parsed_labels": _with(MAIL, then=f"""
      select id, case when toxic = 1 then 0 else len(label_ids) end as n,
             case when toxic = 1 then '' else {_ID_TEXT} end as labels from mail"""),
    "normalised_messages": _with(MAIL, LABEL_DIM, NAMED_LISTS, then=f"""
      select m.id, m.date, m.sender, m.subject,
             {_squeeze("concat_ws(chr(10), nullif(m.body_text, ''), nullif(" + _page_text("p.html") + ", ''))")} as body_text,
             {_LABEL_TEXT} as labels
      from mail m join named_lists n on m.id = n.id left join pages p on p.page_id = m.doc_id"""),
    "deep_payloads": _with(MAIL, then=f"""
      select m.id,
             case when doc_id % 10 in (7, 8) then '' when doc_id % 10 = 9 then m.subject else 'deep' end as subject,
             case when doc_id % 10 in (7, 8) then '' else
               {_squeeze("concat_ws(chr(10), nullif(m.body_text, ''), nullif(" + _page_text("p.html") + ", ''))")} end as body_text,
             case doc_id % 10 when 7 then 'payload is no JSON' when 8 then 'payload is no JSON object' end as payload_error
      from mail m left join pages p on p.page_id = m.doc_id"""),
    "page_text": f"select page_id, {_page_text('html')} as page_text from pages",
    "local_times": """
      select event_id,
             strftime(date_trunc('second', ts) + interval 330 minute, '%Y-%m-%dT%H:%M:%S') || '+05:30' as local_time,
             strftime(ts, '%d%b%Y') as stamp from events""",
    "prompt_texts": _with(MAIL, then=f"""
      select id, {_PROMPT} as prompt,
             'From: ' || sender || chr(10) || 'Subject: ' || subject || chr(10) || 'Body: ' as head
      from mail"""),
    "evaluation_bodies": "select cast(doc_id as varchar) as id, substr(text, 1, 1500) as body from documents",
    "chat_messages": """
      select conv_id, turn, 0 as place, 'system' as role, 'Answer the ' || role as content from conversations
      union all
      select conv_id, turn, 1, 'user', 'Subject: ' || role || chr(10) || 'Body: ' || text from conversations""",
    "parsed_responses": _with(MAIL, then=f"""
      select id, case when {_RESPONSE_OK} then category end as category,
             case when {_RESPONSE_OK} then reason end as reason from mail"""),
    "rule_scores": _with(MAIL, _rule_scores(TABLE_RULES), then="""
      select id, new_category as category, new_reason as reason from scores"""),
    "default_rule_scores": _with(MAIL, _rule_scores(DEFAULT_RULES), then="""
      select id, new_category as category, new_reason as reason from scores"""),
    "client_scores": _with(
        MAIL, f"sized as (select id, length({_PROMPT}) as size from mail)", then="""
      select id, case when size < 1000 then 'ADS' when size < 4000 then 'OTHERS' end as category,
             case when size < 4000 then size || ' characters' end as reason,
             case when size > 6000 then 'ValueError: too long'
                  when size >= 4000 then 'invalid answer' end as error
      from sized"""),
    "ml_scores": _with(*_ML, then="""
      select truth, count(*) as n, count(*) filter (truth = category) as n_correct,
             100.0::double * count(*) filter (truth = category) / count(*) as accuracy_pct
      from val join guesses using (id) group by truth"""),
    "bayes_scores": _with(*_ML, then="""
      select id, truth, category, 'words of labelled messages' as reason from val join guesses using (id)"""),
    "fold_sizes": _with(MAIL, then=f"""
      select 'all' as rows, fold, count(*) as n, min(id) as first_id from ({_folds("mail", 7)}) group by fold
      union all select 'one language', fold, count(*), min(id)
      from ({_folds("(select * from mail where lang = 'es')", 3)}) group by fold"""),
    "cross_validated_accuracy": _with(
        MAIL, f"folded as (select fold, id, lang as category, subject, body_text from ({_folds('mail', 5)}))",
        _bayes("folded", "folded", text="subject", name="_s"), _bayes("folded", "folded", name="_w"),
        then="""
      select 'subject' as candidate_id, fold, count(*) as n, count(*) filter (f.category = g.category) as n_correct
      from folded f join guesses_s g using (id) group by fold
      union all
      select 'whole', fold, count(*), count(*) filter (f.category = g.category)
      from folded f join guesses_w g using (id) group by fold"""),
    "evaluation_run": _with(
        MAIL, TRUTH, """
      kept as (select m.id, m.subject, m.body_text, trim(t.main_label) as category, md5(m.id || '-42') as hash
               from mail m join truth t on m.id = t.id where t.main_label is not null),
      example as (select *, row_number() over (order by hash, id) <= floor(0.75 * count(*) over ()) as trains from kept),
      train as (select 1 as fold, id, category, subject, body_text from example where trains),
      val as (select 0 as fold, id, category as truth, subject, substr(body_text, 1, 1500) as body_text,
                     lower(subject || chr(10) || substr(body_text, 1, 1500)) as words from example where not trains)""",
        _bayes("train", "val"),
        "told as (select 'few words' as candidate_id, id, truth, "
        + _rule_case("words", (("GOOD", ("the",)), ("BAD", ("der", "les")))) + " as guess from val"
        " union all select 'more words', id, truth, "
        + _rule_case("words", (("GOOD", ("the", "and", "del")), ("BAD", ("der", "les", "die")))) + " from val"
        " union all select 'bayes', id, truth, g.category from val join guesses g using (id)),"
        " judged as (select candidate_id, id, coalesce(upper(truth) = upper(guess), false) as ok from told)",
        then="""
      select c.candidate_id, count(*) as n, count(*) filter (c.ok and b.ok) as both,
             count(*) filter (c.ok and not b.ok) as only_candidate, count(*) filter (b.ok and not c.ok) as only_baseline,
             count(*) filter (not b.ok and not c.ok) as neither,
             100.0::double * (count(*) filter (c.ok) - count(*) filter (b.ok)) / count(*) as gain_pct,
             case when count(*) filter (c.ok <> b.ok) = 0 then 0::double else
               (count(*) filter (c.ok) - count(*) filter (b.ok)) / sqrt(count(*) filter (c.ok <> b.ok)::double) end as deviation
      from judged c join judged b on c.id = b.id and b.candidate_id = 'few words'
      where c.candidate_id <> 'few words' group by c.candidate_id"""),
    "category_counts": _with(MAIL, then="""
      select category, count(*) as n from mail where category is not null group by category"""),
    "category_counts_with_null": _with(MAIL, then="""
      select category, count(*) as n from mail group by category"""),
    "category_report": _with(MAIL, then=", " + _report("mail", "category")),
    "distinct_categories": _with(MAIL, then="""
      select count(distinct category) as category, count(distinct sender) as senders,
             count(distinct id) as id from mail"""),
    "stage_counts": _with(MAIL, then="""
      select unnest(['fetched', 'in_scope', 'classified', 'failed']) as stage,
             unnest([count(*), count(*) filter (is_inbox and is_unread),
                     count(*) filter (is_inbox and is_unread and category is not null),
                     count(*) filter (is_inbox and is_unread and category is null)]) as n
      from mail"""),
    "stratified_sample": _with(MAIL, _sample("lang", 20), then="select id, lang as category from sampled"),
    "stratified_sample_large": _with(MAIL, _sample("lang", 130), then="""
      select id, lang as category from sampled"""),
    "sampled_scored": _with(MAIL, _sample("category", 20), then="select id, category, subject from sampled"),
    "train_val_split": _with(MAIL, SPLIT, then="select id, lang as category, split from split"),
    "split_distribution": _with(MAIL, SPLIT, then="""
      select coalesce(lang, 'TOTAL') as category, grouping(lang) as is_total,
             count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val,
             cast(grouping(lang) = 0 and count(*) filter (split = 'train') = 0 as int) as missing_from_train
      from split group by rollup (lang)"""),
    "few_shot_sets": _with(MAIL, SPLIT, """
      placed as (select *, row_number() over (partition by lang order by hash, id) as place_in
                 from split where split = 'train')""", then="""
      select candidate_id, row_number() over (partition by candidate_id order by lang, place_in) - 1 as place,
             id, lang as category, body_text
      from placed, (values ('two each', 2), ('five each', 5)) c(candidate_id, each_n)
      where place_in <= each_n"""),
    "few_shot_rows": _with(MAIL, SPLIT, """
      placed as (select *, row_number() over (partition by lang order by hash, id) as place_in
                 from split where split = 'train')""", then="""
      select candidate_id, row_number() over (partition by candidate_id order by lang, place_in) - 1 as place,
             id, lang as category, body_text
      from placed, (values ('two hundred each', 200), ('five each', 5)) c(candidate_id, each_n)
      where place_in <= each_n"""),
    "registered_best": _registered_best(),
    "distinct_over_days": _with(MAIL, then="""
      select days, unnest(['id', 'from', 'size']) as column,
             unnest([count(distinct id), count(distinct sender), count(distinct n_chars)]) as exact,
             count(*) as row_count, 1 as is_close
      from mail, (values ('first', date '2024-01-01'), ('all', date '2100-01-01')) d(days, last)
      where cast(internal_ts as date) <= last group by days"""),
    "truth_join": _with(MAIL, TRUTH, then="""
      select m.id, m.subject, m.body_text, t.main_label as category, t.reason as truth_reason
      from mail m join truth t on m.id = t.id"""),
    "examples": _with(MAIL, TRUTH, """
      kept as (select m.id, m.subject, trim(t.main_label) as category, md5(m.id || '-42') as hash
               from mail m join truth t on m.id = t.id where t.main_label is not null)""", then="""
      select id, subject, category,
             case when row_number() over (order by hash, id) <= floor(0.75 * count(*) over ())
                  then 'train' else 'val' end as split from kept"""),
    "label_mismatch": _with(MAIL, TRUTH, then="""
      select * from compared where coalesce(old_label <> new_label, true)"""),
    "confusion": _with(MAIL, TRUTH, then="""
      select old_label, new_label, count(*) as n from compared group by 1, 2"""),
    "accuracy": _with(MAIL, TRUTH, """
      judged as (select *, coalesce(upper(trim(old_label)) = upper(trim(new_label)), false) as ok from compared)""",
        then="""
      select new_label, count(*) as n, count(*) filter (ok) as n_correct,
             100.0::double * count(*) filter (ok) / count(*) as accuracy_pct
      from judged group by new_label"""),
    "candidate_accuracy": _with(MAIL, TRUTH, JUDGED, then="select * from results"),
    "candidate_accuracy_by_settings": _with(MAIL, TRUTH, JUDGED, then="select * from results"),
    "scorer_accuracy": _scorer_accuracy(),
    "best_candidate": _with(MAIL, TRUTH, JUDGED, then="""
      select * from results order by accuracy_pct desc, candidate_id limit 1"""),
    "baseline_and_best": _with(MAIL, TRUTH, JUDGED, """
      best as (select * from results order by accuracy_pct desc, candidate_id limit 1)""", then="""
      select r.accuracy_pct as baseline_pct, b.candidate_id as best_id, b.accuracy_pct as best_pct,
             b.accuracy_pct - r.accuracy_pct as gain_pct
      from results r, best b where r.candidate_id = 'over 1500'"""),
    "candidate_registry": _with(MAIL, TRUTH, JUDGED, then="""
      select run_id, candidate_id, n, n_correct
      from results, (values ('first'), ('second')) r(run_id)"""),
    "label_actions": _with(MAIL, LABEL_DIM, ACTIONS, then="select * from actions"),
    "action_summary": _with(MAIL, LABEL_DIM, ACTIONS, then="""
      select outcome, skip_reason, count(*) as n from actions group by 1, 2"""),
    "new_actions": _with(MAIL, LABEL_DIM, ACTIONS, then="""
      select a.id, a.category, a.label_id from actions a join mail m on a.id = m.id
      where a.outcome = 'pending' and coalesce(m.quality, 0) <> 1"""),
    "applied_actions": _with(MAIL, LABEL_DIM, ACTIONS, then="""
      select id, category,
             case when outcome = 'skipped' then outcome when id like '%7' then 'error' else 'applied' end as outcome,
             case when outcome = 'pending' and id like '%7' then 'PermissionError: read only' end as error
      from actions"""),
    "ledger_actions": _with(MAIL, LABEL_DIM, ACTIONS, then="""
      select a.id, a.category, a.label_id from actions a join mail m on a.id = m.id
      where a.outcome = 'pending' and coalesce(m.quality, 0) <> 1"""),
    "rerun_actions": _with(MAIL, LABEL_DIM, ACTIONS, then="""
      select 'inbox-all' as run_id, id, category, outcome, skip_reason from actions where outcome <> 'skipped'
      union all select 'inbox-100', id, category, outcome, skip_reason from actions where outcome = 'skipped'"""),
    "scored_table": _with(MAIL, _rule_scores(TABLE_RULES), """
      unread as (select *, row_number() over (order by internal_ts desc, id) as place
                 from scores where is_inbox and is_unread)""", then="""
      select 'unread' as scope, '19Mar2026' as run_date, cap, id, subject, new_category as category, new_reason as reason
      from unread, (values ('all', 1000000000), ('50', 50)) c(cap, most) where place <= most"""),
    "run_report": _with(
        MAIL, LABEL_DIM, ACTIONS,
        "ranks(rank, category) as (values "
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES, 1)) + ")",
        """
      present as (
        select rank, r.category, l.label_id, count(l.label_id) over () || '/' || count(*) over () as covered
        from ranks r left join category_label l on r.category = l.category),
      sizes as (select category, count(*) as n from mail where category is not null group by 1),
      results as (
        select id, case when outcome = 'skipped' then outcome when id like '%7' then 'error' else 'applied' end as outcome,
               skip_reason, category from actions),
      outcomes as (select outcome, skip_reason, count(*) as n from results group by 1, 2),
      faults as (select id, row_number() over (order by id, category) as place from results where outcome = 'error')""",
        then="""
      select 'labels' as section, rank as position, category as name, cast(label_id is not null as bigint) as n,
             null::double as share_pct, covered as detail from present
      union all select 'stages', 1, 'fetched', count(*), null, null from mail
      union all select 'stages', 2, 'classified', count(category), null, null from mail
      union all select 'stages', 3, 'failed', count(*) - count(category), null, null from mail
      union all select 'categories', row_number() over (order by n desc, category), category, n,
             100.0::double * n / sum(n) over (), repeat('█', cast(ceil(n * 60::double / max(n) over ()) as bigint)) from sizes
      union all select 'actions', row_number() over (order by outcome, skip_reason nulls first), outcome, n,
             100.0::double * n / sum(n) over (), skip_reason from outcomes
      union all select 'errors', place, id, null, null, 'PermissionError: read only' from faults where place <= 5"""),
    "landing_messages": _with(MAIL, then="""
      select 'message' as kind, id, strftime(internal_ts, '%Y-%m-%d %H:%M:%S') as sent,
             cast(is_inbox as int) as is_inbox, cast(is_unread as int) as is_unread, cast(is_primary as int) as is_primary,
             null as reject_reason, 0 as has_line
      from mail where coalesce(toxic, 0) <> 1 and doc_id % 10 <> 3
      union all
      select 'reject', null, null, null, null, null,
             case when toxic = 1 then 'not a JSON object of the schema' else 'no id' end, 1
      from mail where toxic = 1 or doc_id % 10 = 3"""),
    "ingested_scope": _with(MAIL, then="""
      select id, date, sender, subject from mail where not reviewed or (is_inbox and is_unread)"""),
    "csv_round_trip": _with(MAIL, then=f"""
      select id, date, sender, subject, body_text, {_ID_TEXT} as labels, category, reason from mail"""),
    "bronze_cache": _with(MAIL, then=f"""
      select id, date, subject, body_text, {_ID_TEXT} as labels from mail where is_inbox and is_unread"""),
    "run_manifest": _with(MAIL, then="""
      select 'unread' as scope, '19Mar2026' as run_date, count(*) as row_count from mail
      where is_inbox and is_unread
      union all select 'inbox', '19Mar2026', count(*) from mail where is_inbox"""),
    "label_study": _with(MAIL, f"""
      held as (select id, unnest(label_ids) as label from mail),
      tags as (select id, [x for x in label_ids if x not in {_IGNORED}] as tags from mail),
      ignored as (select i.label, count(distinct h.id) as n
                  from (select unnest([%s]) as label) i left join held h on i.label = h.label group by i.label)
      """ % _IGNORED.strip("()"), then=f"""
      select 'tags' as section, row_number() over (order by label) as position, label as name, n
      from (select label, count(distinct id) as n from held where label not in {_IGNORED} group by label)
      union all select 'ignored', row_number() over (order by n desc, label), label, n from ignored
      union all select 'tags_per_message', row_number() over (order by size), cast(size as varchar), n
      from (select len(tags) as size, count(*) as n from tags group by 1)
      union all select 'main_labels', row_number() over (order by n desc, name), name, n
      from (select coalesce(tags[1], '') as name, count(*) as n from tags group by 1)
      union all select 'categories', row_number() over (order by n desc, category nulls last), category, n
      from (select category, count(*) as n from mail group by 1)"""),
    "reviewed_sample": _with(MAIL, _sample("category", 10), then="""
      select id, category, reason, body_text from sampled"""),
    "compared_reviews": _with(MAIL, TRUTH, then="""
      select 'all' as id, cast(count(*) as varchar) as n_both, cast(count(distinct old_label) as varchar) as old_labels,
             cast(count(distinct new_label) as varchar) as new_labels,
             cast(count(*) filter (coalesce(old_label <> new_label, true)) as varchar) as n_mismatch from compared
      union all
      select id, null, old_label, new_label, null from compared where coalesce(old_label <> new_label, true)"""),
    "daily_job": _with(*_JOB, then="""
      select s.id, s.category, c.label_id,
             case when c.label_id is null then 'skipped' when s.id like '%7' then 'error' else 'applied' end as outcome,
             case when c.label_id is null then 'no label' end as skip_reason,
             case when c.label_id is not null and s.id like '%7' then 'PermissionError: read only' end as error
      from streamed s left join category_label c on s.category = c.category"""),
    "dry_run_job": _with(*_JOB, then="select id, category from streamed where is_primary"),
    "incremental_actions": _with(*_JOB, then="""
      select s.id, s.category, c.label_id,
             case when c.label_id is null then 'skipped' else 'pending' end as outcome,
             case when c.label_id is null then 'no label' end as skip_reason
      from streamed s left join category_label c on s.category = c.category"""),
}
