"""DuckDB SQL for every query of the catalog, over the same tables."""

from __future__ import annotations

from tallyloom.functions.answers import DELETIONS, NUMBER, REWRITES
from tallyloom.functions.columns import WHITESPACE
from tallyloom.plans import inputs

ORACLES: dict[str, str] = {}

SPACE = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
BREAK = r"[ \t\n\r\f\x0b]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACE})"


def numeric(expr: str) -> str:
    number = f"round_even(try_cast(replace({strip(expr)}, '_', '') as double), 0)"
    return (
        f"case when regexp_matches({strip(expr)}, {text(NUMBER)}) and {number} >= 0 and {number} < 'inf'::double"
        f" then cast({number} % 1000 as int) end"
    )


def boxed(relation: str, keys: str, source: str, out: str) -> str:
    """Adds ``out``: the content of the last box in ``source``."""
    return f"""select {keys}, {source}, case when contains({source}, '\\boxed') and starts_with(tail, '{{')
        then substr(tail, 2, closing - 2) end as {out}
      from (select *, list_filter(range(1, length(tail) + 1), lambda i:
          length(replace(left(tail, i), '{{', '')) = length(replace(left(tail, i), '}}', '')))[1] as closing
        from (select *, string_split({source}, '\\boxed')[-1] as tail from ({relation})))"""


def clean(relation: str, keys: str, source: str, out: str) -> str:
    """Adds ``out``: the normalised form of ``source``."""
    expr = f"split_part({source}, 'Problem:', 1)"
    for old, new in REWRITES:
        expr = f"replace({expr}, {text(old)}, {text(new)})"
    for word in DELETIONS:
        expr = f"replace({expr}, {text(word)}, '')"
    # The wrappers and lead-ins of the clean-up, in DuckDB's spelling.
    for wrapper in (r"\\text\{(.*?)\}", r"\\textbf\{(.*?)\}", r"\\overline\{(.*?)\}", r"\\boxed\{(.*)\}"):
        expr = rf"regexp_replace({expr}, '{wrapper}', '\1', 'g')"
    sql = f"select {keys}, {expr} as t from ({relation})"
    for lead_in in ("finalansweris(.*)", "answer?is:?(.*)", r"oxed\{(.*?)\}", r"\$(.*?)\$"):
        sql = f"select {keys}, coalesce(regexp_extract_all(t, '{lead_in}', 1)[-1], t) as t from ({sql})"
    sql = f"select {keys}, {strip('t')} as t from ({sql})"
    sql = rf"""select {keys}, case when contains(t, 'rac') and not contains(t, '\frac')
        then replace(t, 'rac', '\frac') else t end as t from ({sql})"""
    sql = rf"select {keys}, regexp_replace(t, 'frac([^{{])(.)', 'frac{{\1}}{{\2}}', 'g') as t from ({sql})"
    sql = rf"select {keys}, replace(regexp_replace(t, 'sqrt([^{{])', 'sqrt{{\1}}', 'g'), '$', '') as t from ({sql})"
    return f"""select {keys}, case when regexp_full_match(replace(t, ',', ''), '[0-9]+')
        then replace(t, ',', '') else t end as {out} from ({sql})"""


def final(relation: str, keys: str, source: str, out: str) -> str:
    """Adds ``out``: the clean answer in the last box, or in all of ``source``."""
    inner = boxed(relation, keys, source, "b")
    stated = f"select {keys}, case when contains({source}, 'boxed') then b else {source} end as s from ({inner})"
    return clean(stated, keys, "s", out)


CANDIDATES = """select user_id as problem_id, event_id,
    case when event_type = 'error' then '-1' else cast(value as varchar) end as answer from events"""
NUMERIC = f"select *, {numeric('answer')} as candidate from ({CANDIDATES})"
SOLUTIONS = f"""select user_id as problem_id, event_id, cast(event_id % 3 as int) as round,
    {inputs.DECORATED_ANSWER} as solution from events"""
TRUTH = """select user_id as problem_id, concat('p', user_id) as problem,
    cast(floor(arg_min(value, event_id)) as int) as known from events group by user_id"""


def vote(candidates: str, order: str) -> str:
    return f"""select p.problem_id, coalesce(v.candidate, 0) as answer
      from (select distinct problem_id from ({candidates})) p left join (
        select problem_id, candidate from (
          select problem_id, candidate, row_number() over (
            partition by problem_id order by count(*) desc, min({order})) as place
          from ({candidates}) where candidate is not null group by problem_id, candidate)
        where place = 1) v using (problem_id)"""


VOTES = vote(NUMERIC, "event_id")
ORACLES["majority_vote"] = VOTES
ORACLES["incremental_vote"] = VOTES
ORACLES["vote_with_defaults"] = f"""
  select c_custkey as problem_id, coalesce(answer, 0) as answer
  from customer left join ({VOTES}) v on c_custkey = v.problem_id"""
ORACLES["vote_accuracy"] = f"""
  select count(*) as n_problems,
    round(avg(cast(((known % 1000) + 1000) % 1000 = answer as int)), 6) as accuracy
  from ({TRUTH}) join ({VOTES}) using (problem_id)"""
ORACLES["candidate_counts"] = f"""
  select problem_id, count(*) as n_candidates, count(candidate) as n_filtered from ({NUMERIC}) group by problem_id"""
ORACLES["candidate_list"] = f"""
  select problem_id, event_id, answer,
    row_number() over (partition by problem_id order by event_id) - 1 as place from ({CANDIDATES})"""

VALIDATION = """select o_orderkey as id, o_orderpriority as problem, -1 as answer,
    cast(((cast(trunc(o_totalprice) as bigint) % 1000) + 1000) % 1000 as int) as ground_truth from orders"""
ORACLES["validation_set"] = VALIDATION
ORACLES["validation_head"] = f"select * from ({VALIDATION}) order by id limit 10"
ORACLES["validation_shuffled"] = f"""
  select id, concat('### Problem: ', problem, chr(10), '### Solution: ') as text,
    row_number() over (order by md5(concat('7:', id)), id) as place from ({VALIDATION})"""
ORACLES["prompt_render"] = """
  select doc_id, concat('### Problem: Solve: ', text, chr(10), 'Hint: {}', chr(10), '### Solution: ') as text
  from documents"""
ORACLES["problem_fanout"] = """
  select doc_id as problem_id, unnest(range(4)) as sample_id,
    concat('### Problem: ', text, chr(10), '### Solution: ') as text from documents"""


def chat(turn: str, head: str, tail: str) -> str:
    return f"""
  select conv_id, turn, concat(
    case when turn = first_turn and role <> 'system' then {head} else '' end, {turn},
    case when turn = last_turn then {tail} else '' end) as text
  from (select conv_id, turn, role, coalesce(text, '') as text, min(turn) over (partition by conv_id) as first_turn,
      max(turn) over (partition by conv_id) as last_turn from conversations)"""


PROBLEM_TURN = """case role when 'user' then concat('### Problem: ', text, chr(10))
    when 'assistant' then concat('### Solution: ', text, chr(10)) else '' end"""
CHATML_TURN = "concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10))"
CHATML_HEAD = "concat('<|im_start|>system', chr(10), '<|im_end|>', chr(10))"
OPENER = "case when role = 'user' then '### Solution: ' else '' end"
ORACLES["chat_render_sft"] = chat(PROBLEM_TURN, "''", "''")
ORACLES["chat_render_generation"] = chat(PROBLEM_TURN, "''", OPENER)
ORACLES["chatml_render"] = chat(CHATML_TURN, CHATML_HEAD, "''")
ORACLES["chatml_render_generation"] = chat(
    CHATML_TURN, CHATML_HEAD, "concat('<|im_start|>assistant', chr(10))"
)


def token_list(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{BREAK}'), lambda x: x <> '')"


MESSAGES = """select doc_id, doc_id % 3 <> 0 as answered, coalesce(text, '') as text,
    coalesce(concat('In ', lang), '') as reply from documents"""
ORACLES["messages_render_sft"] = f"""
  select doc_id, concat('### Problem: ', text, chr(10),
    case when answered then concat('### Solution: ', reply, chr(10)) else '' end) as text from ({MESSAGES})"""
ORACLES["messages_render_generation"] = f"""
  select doc_id, concat('<|im_start|>system', chr(10), '<|im_end|>', chr(10), '<|im_start|>user', chr(10), text,
    '<|im_end|>', chr(10), case when answered then concat('<|im_start|>assistant', chr(10), reply, '<|im_end|>', chr(10))
    else '' end, '<|im_start|>assistant', chr(10)) as text from ({MESSAGES})"""
ORACLES["config_render"] = f"""
  select doc_id, t.text as training, concat(t.text, case when answered then '' else '### Solution: ' end) as prompt,
    g.text as default_prompt
  from ({MESSAGES}) m join ({ORACLES["messages_render_sft"]}) t using (doc_id)
  join ({ORACLES["messages_render_generation"]}) g using (doc_id)"""
ORACLES["config_turns"] = ORACLES["chat_render_generation"]
ORACLES["messages_calibration"] = f"""
  select doc_id, text, cast(len({token_list('text')}) as int) as n_tokens from (
    select doc_id, concat('### Problem: ', text, chr(10), '### Solution: ',
      case when answered then reply else '' end, chr(10)) as text from ({MESSAGES}))
  order by md5(concat('42:', doc_id)), doc_id limit 256"""
ORACLES["messages_mask"] = """
  select doc_id, 'user' as role, true as masked, cast(length(text) as int) as n_chars from documents
  union all select doc_id, 'assistant', false, cast(length(concat('In ', lang)) as int) from documents
  where doc_id % 3 <> 0"""
ORACLES["calibration_sample"] = f"""
  select conv_id, text, cast(len({token_list('text')}) as int) as n_tokens from (
    select conv_id, concat('### Problem: ', list(text order by turn)[1], chr(10),
      '### Solution: ', coalesce(list(text order by turn)[2], ''), chr(10)) as text
    from conversations group by conv_id)
  order by md5(concat('42:', conv_id)), conv_id limit 256"""
ORACLES["user_turn_mask"] = """
  select conv_id, count(*) filter (where role = 'user') as n_masked, count(*) as n_turns
  from conversations group by conv_id"""

ORACLES["boxed_extract"] = f"select event_id, boxed from ({boxed(SOLUTIONS, 'event_id', 'solution', 'boxed')})"
ORACLES["answer_normalize"] = clean(SOLUTIONS, "event_id", "solution", "clean")
ORACLES["document_normalize"] = clean("select doc_id, text from documents", "doc_id", "text", "clean")
ORACLES["region_normalize"] = clean(
    "select doc_id, right(text, 100) as region from documents", "doc_id", "region", "clean"
)
ORACLES["numeric_filter"] = f"""select event_id, {numeric('f')} as answer
  from ({final(SOLUTIONS, 'event_id', 'solution', 'f')}) where {numeric('f')} is not null"""

SHARES = ", ".join(f"({at}, '{name}', {share}::double)" for at, (name, share) in enumerate(inputs.MIX_SPEC.items()))
MIX = f"""
  select split, pos as mix_pos, doc_id as row_key, text as prompt from (
    select *, row_number() over (partition by source, split order by doc_id) as rn,
      count(*) over (partition by source, split) as n
    from (select *, case when cast(floor(doc_id / 20) as bigint) % 10 = 0 then 'test' else 'train' end as split
      from documents))
  join (values {SHARES}) f(pos, source, share) using (source)
  where split = 'test' or rn <= cast(floor(share * n) as bigint)"""
ORACLES["mix_fractions"] = MIX
NAMED = """
  select row_id % 10 = 0 as is_test, * from (
    select 0 as pos, 0.3 as share, doc_id as row_id, text as prompt, lang as completion, null::double as score from documents
    union all select 1, 1.0, item_id, text, null, null from benchmark
    union all select 2, 0.25, event_id, event_type, null, value * 2 from events)"""
NAMED_MIX = f"""
  select case when is_test then 'test' else 'train' end as split, cast(pos as int) as mix_pos, row_id as row_key,
    prompt, completion, score from (
    select *, row_number() over (partition by pos, is_test order by row_id) as rn,
      count(*) over (partition by pos, is_test) as n from ({NAMED}))
  where is_test or rn <= cast(floor(share * n) as bigint)"""
ORACLES["mix_named"] = NAMED_MIX
ORACLES["mix_rendered"] = f"""
  select split, mix_pos, row_key, concat('### Problem: ', coalesce(prompt, ''), chr(10), '### Solution: ',
    case when mix_pos = 0 then coalesce(completion, '') else 'none' end, chr(10)) as text from ({NAMED_MIX})"""
# Rows of a view come in the order of its files.
ORACLES["file_prefix"] = """
  select row_number() over () - 1 as place, doc_id, lang, text
  from (select * from documents limit (select cast(floor(0.3::double * count(*)) as bigint) from documents))"""
ORACLES["revision_rows"] = """
  select revision, split, doc_id, lang from documents
  join (values ('v1', 'train', 0), ('v1', 'test', 1), ('main', 'train', 0), ('main', 'train', 2), ('main', 'test', 1))
    r(revision, split, part) on doc_id % 3 = part"""
ORACLES["mix_reader_order"] = """
  with rows as (
    select 0 as pos, 0.3::double as share, case when doc_id % 10 = 0 then 'test' else 'train' end as split, doc_id as id,
      text as prompt, lang as completion from documents
    union all select 1, 0.55, 'train', item_id, text, null from benchmark
    union all select 1, 0.55, 'test', item_id, text, null from benchmark where item_id % 7 = 0)
  select split, cast(pos as int) as mix_pos, place - 1 as row_key, prompt, completion from (
    select *, row_number() over (partition by pos, split order by id) as place, count(*) over (partition by pos, split) as n from rows)
  where split = 'test' or place <= cast(floor(share * n) as bigint)"""
ORACLES["mix_split_rows"] = f"select split, count(*) as n_rows from ({MIX}) group by split"
ORACLES["mix_train_order"] = f"""
  select *, row_number() over (order by digest, mix_pos, row_key) as place from (
    select mix_pos, row_key, md5(concat('42:', mix_pos, ':', row_key)) as digest from ({MIX}) where split = 'train')"""
ORACLES["seeded_shuffle_rank"] = """
  select doc_id, row_number() over (order by md5(concat('42:', doc_id)), doc_id) as place from documents"""
ORACLES["sample_three"] = """
  select doc_id, text from documents order by md5(concat('3:', doc_id)), doc_id limit 3"""
ORACLES["reported_samples"] = """
  select case when cast(floor(doc_id / 20) as bigint) % 10 = 0 then 'test' else 'train' end as split,
    count(*) as n_all, least(500, count(*)) as n_reported from documents group by 1"""
ORACLES["perplexity_metrics"] = """
  select event_type, least(1500, count(*)) as eval_samples, round(avg(value / 1000), 6) as eval_loss,
    round(exp(avg(value / 1000)), 6) as perplexity from events group by event_type"""
ORACLES["validation_split"] = """
  select source, case when cast(concat('0x', left(md5(concat('42:', doc_id)), 8)) as bigint) / 4294967296.0 < 0.05
    then 'validation' else 'train' end as split, count(*) as n_rows from documents group by 1, 2"""


def steps(restart: bool, num_steps: int = 4) -> str:
    """The relations of a scoring run; ``done`` holds the final state."""
    setback = "restart" if restart else "prune"
    no_code = "restart" if restart else "no_code"
    parts = [
        f"""e as (select user_id as problem_id, event_id as sample_id, event_type as k, {inputs.WHOLE_VALUE} as v
          from events)""",
        f"""x as (select *, {inputs.CODE} as code, {inputs.REQUEST} as request, unnest(range({num_steps})) as step
          from e)""",
        f"c as (select problem_id, sample_id, step, {inputs.COMPLETION} as completion, {inputs.OUTPUT} as output from x)",
        """s0 as (select problem_id, sample_id, concat('### Problem: p', problem_id, chr(10), '### Solution: ') as text,
          concat('### Problem: p', problem_id, chr(10), '### Solution: ') as gen_texts,
          cast(null as int) as pruned_step, true as has_code, cast(null as varchar) as region from e)""",
    ]
    for i in range(num_steps):
        asks = "ends_with(g, concat('```output', chr(10)))"
        states = "(contains(right(g, 100), 'answer is') or contains(right(g, 100), '\\boxed'))"
        rest = "'keep'" if i == num_steps - 1 else f"case when not {asks} then '{setback}' else 'execute' end"
        parts.append(
            f"""g{i} as (select s.*, c.output,
              case when pruned_step is null then concat(gen_texts, c.completion) else gen_texts end as g
            from s{i} s join c on c.problem_id = s.problem_id and c.sample_id = s.sample_id and c.step = {i})"""
        )
        parts.append(
            f"""v{i} as (select *, case when pruned_step is not null then 'over'
              when not regexp_matches(g, '(?s)```python.*?```') then '{no_code}'
              when not {asks} and {states} and not regexp_matches(g, '(?s)```output.*?```') then 'prune'
              when not {asks} and {states} then 'answer' else {rest} end as verdict from g{i})"""
        )
        parts.append(
            f"""s{i + 1} as (select problem_id, sample_id, text,
              case verdict when 'restart' then text
                when 'execute' then concat(g, case when length(output) > 200
                  then concat(left(output, 200), ' ... (output truncated)') else output end, chr(10), '```')
                else g end as gen_texts,
              case when verdict in ('prune', 'no_code') then {i} else pruned_step end as pruned_step,
              has_code and verdict <> 'no_code' as has_code,
              case when verdict = 'answer' then right(g, 100) else region end as region from v{i})"""
        )
    keys = "problem_id, sample_id, text, gen_texts, pruned_step, has_code"
    answers = final(f"select * from s{num_steps}", keys, "region", "a")
    parts.append(
        f"""done as (select problem_id, sample_id, text, gen_texts, pruned_step is not null as should_prune,
          coalesce(a, '-1') as model_answers, has_code, pruned_step from ({answers}))"""
    )
    return "with " + ",\n".join(parts)


def trace_vote(restart: bool) -> str:
    candidates = f"""select problem_id, {numeric('model_answers')} as candidate,
      coalesce(pruned_step, 4)::bigint * 1000000000 + sample_id as place from done"""
    return f"{steps(restart)} {vote(candidates, 'place')}"


ORACLES["trace_scoring_restart"] = f"{steps(True)} select * from done"
ORACLES["trace_scoring_prune"] = f"{steps(False)} select * from done"
ORACLES["trace_vote_restart"] = trace_vote(True)
ORACLES["trace_vote_prune"] = trace_vote(False)
ORACLES["trace_survivors"] = (
    f"{steps(False)} select pruned_step, count(*) as n_traces from done group by pruned_step"
)
LONG_EVENTS = f"""select user_id as problem_id, event_id as sample_id, event_type as k, {inputs.WHOLE_VALUE} as v from events"""
LONG_STEP = f"""select problem_id, sample_id, number, {inputs.COMPLETION} as completion, {inputs.OUTPUT} as output
  from (select *, {inputs.CODE} as code, {inputs.REQUEST} as request, number % {inputs.CYCLE} as step
    from (select *, unnest(range(64)) as number from ({LONG_EVENTS})))"""
LONG_STATE = f"""with recursive c as ({LONG_STEP}), s as (
    select problem_id, sample_id, 0::bigint as number, concat('### Problem: p', problem_id, chr(10), '### Solution: ') as gen_texts,
      concat('### Problem: p', problem_id, chr(10), '### Solution: ') as prompt,
      cast(null as int) as pruned_step, true as has_code, cast(null as varchar) as region from ({LONG_EVENTS})
    union all
    select problem_id, sample_id, number + 1, case verdict when 'restart' then prompt
        when 'execute' then concat(g, case when length(output) > 200
          then concat(left(output, 200), ' ... (output truncated)') else output end, chr(10), '```') else g end,
      prompt, case when verdict = 'prune' then number::int else pruned_step end, has_code,
      case when verdict = 'answer' then right(g, 100) else region end
    from (select *, case when pruned_step is not null then 'over'
        when not regexp_matches(g, '(?s)```python.*?```') then 'restart'
        when not asks and states and not regexp_matches(g, '(?s)```output.*?```') then 'prune'
        when not asks and states then 'answer' when number = 63 then 'keep'
        when not asks then 'restart' else 'execute' end as verdict
      from (select *, ends_with(g, concat('```output', chr(10))) as asks,
          contains(right(g, 100), 'answer is') or contains(right(g, 100), '\\boxed') as states
        from (select s.*, c.output,
            case when s.pruned_step is null then concat(s.gen_texts, c.completion) else s.gen_texts end as g
          from s join c on c.problem_id = s.problem_id and c.sample_id = s.sample_id and c.number = s.number)))
  ), done as (select * from s where number = 64)"""
ORACLES["trace_scoring_long"] = f"""{LONG_STATE}
  select problem_id, sample_id, length(gen_texts)::int as n_chars, md5(gen_texts) as digest, coalesce(a, '-1') as model_answers,
    has_code, pruned_step
  from ({final('select * from done', 'problem_id, sample_id, gen_texts, has_code, pruned_step', 'region', 'a')})"""
ORACLES["code_block_stats"] = f"""{steps(False)}
  select problem_id, sample_id, n_code, n_output, region, asks, states, code,
    contains(code, 'subprocess') or contains(code, 'venv') as blocked from (
    select problem_id, sample_id,
      cast(len(regexp_extract_all(gen_texts, '(?s)```python(.*?)```', 1)) as int) as n_code,
      cast(len(regexp_extract_all(gen_texts, '(?s)```output(.*?)```', 1)) as int) as n_output,
      right(gen_texts, 100) as region,
      ends_with(gen_texts, concat('```output', chr(10))) as asks,
      contains(right(gen_texts, 100), 'answer is') or contains(right(gen_texts, 100), '\\boxed') as states,
      regexp_extract_all(gen_texts, '(?s)```python(.*?)```', 1)[-1] as code from done)"""

REPORTS = f"""
  select event_id, {strip("string_agg(shown, chr(10) order by line_no)")} as report from (
    select event_id, line_no, case when kind = 1 then
        case when strpos(line, '"/') > 0 then replace(line, substr(line, strpos(line, '"/') + 1), '') else '' end
      else line end as shown
    from (select *, case when kind > 0 then
          lag(kind) over (partition by event_id, kind > 0 order by line_no) end as before
      from (select *, case when contains(line, 'Traceback') or line = lines[-1] then 0
          when contains(line, script) then 1 else 2 end as kind
        from (select *, lines[line_no] as line from (
          select *, unnest(range(1, len(lines) + 1)) as line_no from (
            select event_id, {inputs.SCRIPT} as script, string_split({strip(inputs.STDERR)}, chr(10)) as lines
            from events)))))
    where kind < 2 or before = 1)
  group by event_id"""
ORACLES["traceback_compact"] = REPORTS
ORACLES["execution_text"] = f"""
  select event_id, concat('> ', case when length(shown) > 200
    then concat(left(shown, 200), ' ... (output truncated)') else shown end, chr(10), '```') as shown from (
    select e.event_id, case when event_type <> 'error' then cast(value as varchar) else report end as shown
    from events e join ({REPORTS}) r on e.event_id = r.event_id)"""
ORACLES["generated_answers"] = """
  select doc_id, concat('There are ', length(text) - length(replace(text, chr(10), '')) + 1, ' lines.') as completion
  from documents"""

LIVE = f"""select *, case when k <> 'error' then right(gen_texts, 100) end as region from (
    select *, case when k = 'error' then text else concat(text, '```python', chr(10), 'print(', v, ')', chr(10), '```',
      chr(10), '```output', chr(10), v, chr(10), '```', chr(10), 'The answer is $', v, '$.') end as gen_texts
    from (select user_id as problem_id, event_id as sample_id, event_type as k, {inputs.WHOLE_VALUE} as v,
      concat('### Problem: ', {inputs.WHOLE_VALUE}, ' ', event_type, chr(10), '### Solution: ') as text from events))"""
ORACLES["live_scoring"] = f"""
  select problem_id, sample_id, text, gen_texts, false as should_prune, coalesce(a, '-1') as model_answers,
    true as has_code, cast(null as int) as pruned_step
  from ({final(LIVE, 'problem_id, sample_id, text, gen_texts', 'region', 'a')})"""
ORACLES["stored_predictions"] = VOTES
ORACLES["streamed_traces"] = trace_vote(True)
ORACLES["logged_answers"] = """
  select row_number() over (order by md5(concat('5:', s_suppkey)), s_suppkey) - 1 as place, s_suppkey as id,
    cast(((trunc(s_acctbal)::bigint % 1000) + 1000) % 1000 as int) as answer from supplier"""
ORACLES["stored_metrics"] = ORACLES["perplexity_metrics"]

MATCHES = f"""select problem_id, event_id, round, final_answer
  from ({final(SOLUTIONS, 'problem_id, event_id, round', 'solution', 'final_answer')})
  join ({final('select problem_id, cast(known as varchar) as known from (' + TRUTH + ')', 'problem_id', 'known', 'expected')})
  using (problem_id) where final_answer = expected"""
ORACLES["answer_match"] = f"select problem_id, event_id, final_answer from ({MATCHES})"
ORACLES["rejection_rounds"] = f"""with m as ({MATCHES})
  select problem_id, event_id, round, final_answer from m where not exists (
    select 1 from m earlier where earlier.problem_id = m.problem_id and earlier.round < m.round)"""
ORACLES["unsolved_problems"] = f"""
  select problem_id from ({TRUTH}) where problem_id not in (select problem_id from ({MATCHES}))"""
ORACLES["generated_rounds"] = f"""
  select problem_id, cast(attempt // 2 as int) as round, cast(attempt % 2 as int) as sample_id, cast(known as varchar) as final_answer
  from ({TRUTH}), (select unnest(range(6)) as attempt)
  where attempt >= problem_id % 7 and attempt // 2 = (problem_id % 7) // 2"""
ORACLES["numeric_problems"] = f"""
  select event_id, solution from ({SOLUTIONS}) where {numeric('solution')} is not null"""
ORACLES["integer_problems"] = f"""
  select problem_id, event_id, answer from ({CANDIDATES})
  where {numeric('answer')} is not null and try_cast(answer as double) = floor(try_cast(answer as double))"""

COUNTS = f"select doc_id, cast(len({token_list('text')}) as int) as n_tokens from documents"
ORACLES["token_count"] = COUNTS
ORACLES["token_truncate"] = f"""
  select doc_id, array_to_string(t[1:64], ' ') as head,
    array_to_string(t[greatest(len(t) - 63, 1):], ' ') as tail
  from (select doc_id, {token_list('text')} as t from documents)"""
ORACLES["pack_blocks"] = f"""
  select block_id, doc_id, greatest(block_id * 1024 - first_token, 0) as start,
    least((block_id + 1) * 1024 - first_token, n) - greatest(block_id * 1024 - first_token, 0) as len,
    (block_id + 1) * 1024 > total as is_partial
  from (select *, unnest(range(first_token // 1024, (first_token + n - 1) // 1024 + 1)) as block_id from (
    select doc_id, cast(n_tokens as bigint) as n,
      cast(sum(n_tokens) over (order by doc_id) as bigint) - n_tokens as first_token,
      cast(sum(n_tokens) over () as bigint) as total
    from ({COUNTS}) where n_tokens > 0))"""
ORACLES["packed_tokens"] = f"""
  select block_id, cast(count(*) as int) as n_tokens, string_agg(token, ' ' order by doc_id, spot) as text from (
    select doc_id, spot, token, (row_number() over (order by doc_id, spot) - 1) // 1024 as block_id from (
      select doc_id, unnest(range(1, len(t) + 1)) as spot, unnest(t) as token
      from (select doc_id, {token_list('text')} as t from documents)))
  group by block_id"""
ORACLES["packed_mask"] = f"""
  select block_id, cast(count(*) as int) as n_tokens, string_agg(token, ' ' order by conv_id, turn, spot) as text,
    string_agg(case when role <> 'user' then '1' else '0' end, '' order by conv_id, turn, spot) as mask from (
    select *, (row_number() over (order by conv_id, turn, spot) - 1) // 1024 as block_id from (
      select conv_id, turn, role, unnest(range(1, len(t) + 1)) as spot, unnest(t) as token
      from (select conv_id, turn, role, {token_list(PROBLEM_TURN)} as t
        from (select conv_id, turn, role, coalesce(text, '') as text from conversations))))
  group by block_id"""
ORACLES["encoded_blocks"] = """
  select block_id, cast(count(*) as int) as n_tokens, string_agg(length(word), ' ' order by doc_id, spot) as ids from (
    select *, (row_number() over (order by doc_id, spot) - 1) // 1024 as block_id from (
      select doc_id, unnest(range(1, len(t) + 1)) as spot, unnest(t) as word
      from (select doc_id, string_split(text, ' ') as t from documents where text is not null)))
  group by block_id"""
ORACLES["max_length_filter"] = f"select doc_id, text from documents where len({token_list('text')}) < 128"
ORACLES["prompt_completion_pairs"] = """
  select doc_id, concat('Topic: ', source) as prompt, text as completion from documents"""
CUT = r"^[ \t\n\r\f\x0b]*(?:[^ \t\n\r\f\x0b]+[ \t\n\r\f\x0b]+){0,127}[^ \t\n\r\f\x0b]+"
ORACLES["prompt_completion_cut"] = f"""
  select doc_id, concat('Topic: ', source) as prompt, case when len({token_list('text')}) > 128
    then regexp_extract(text, '{CUT}') else text end as completion from documents"""
ORACLES["prediction_rows"] = "select doc_id, lang from documents order by doc_id limit 50"
