"""Every operator as a query over the given tables: name -> f(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, templates, tokens
from ..functions.answers import boxed_answer, numeric_answer, with_clean_answer
from ..functions.digests import seeded_digest
from ..operators import fields, metrics, votes
from ..operators.conversations import render_turns, user_turns
from ..operators.order import first_by_digest, first_rows, with_digest_rank
from ..operators.packing import encode_sequences, fill_blocks, label_mask, label_spans, pack_texts, place_sequences
from ..operators.packing import pack_blocks as pack
from ..session import settle, work_folder
from ..sources.answer_log import AnswerLog
from ..sources.datasets import read_split, write_metrics
from ..sources.problems import problem_feed, validation_problems, write_predictions
from ..sources.reader_order import file_rows, reader_prefix, with_reader_place
from ..sources.revisions import commit_revision
from ..streaming.incremental import current_votes, open_stream, start_tally
from ..streaming.traces import start_scoring, step_stream, votes_so_far
from . import inputs, mixing, rejection, tracing
from .calibration import calibration_sample as draw_calibration
from .calibration import calibration_turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BLOCK_SIZE = 1024
MAX_TOKENS = 64
LONG_STEPS = 64


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _numeric(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.candidates(spark, folder).withColumn("candidate", numeric_answer("answer"))


# --- votes -----------------------------------------------------------------


@query
def majority_vote(spark, folder):
    return votes.majority_vote(_numeric(spark, folder), "problem_id", "candidate", ["event_id"])


@query
def vote_with_defaults(spark, folder):
    """Every customer is a problem; those without events get the answer 0."""
    problems = inputs.table(spark, folder, "customer").select(F.col("c_custkey").alias("problem_id"))
    return votes.majority_vote(_numeric(spark, folder), "problem_id", "candidate", ["event_id"], problems)


@query
def vote_accuracy(spark, folder):
    truth = validation_problems(inputs.truth(spark, folder), "known")
    predictions = majority_vote(spark, folder).select(
        "problem_id",
        F.concat(F.lit("p"), F.col("problem_id").cast("string")).alias("problem"),
        F.col("answer").alias("model_answer"),
    )
    result = votes.accuracy(truth, predictions, ["problem_id", "problem"], "ground_truth", "model_answer")
    return result.select("n_problems", F.round("accuracy", 6).alias("accuracy"))


@query
def candidate_counts(spark, folder):
    return votes.candidate_counts(_numeric(spark, folder), "problem_id", "candidate")


@query
def candidate_list(spark, folder):
    return votes.candidate_list(inputs.candidates(spark, folder), "problem_id", ["event_id"])


# --- problems and prompts --------------------------------------------------


@query
def validation_set(spark, folder):
    orders = inputs.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("problem"), F.col("o_totalprice").alias("answer")
    )
    return validation_problems(orders)


@query
def validation_head(spark, folder):
    return first_rows(validation_set(spark, folder), ["id"], 10)


@query
def validation_shuffled(spark, folder):
    # Ranked as keys and problems; the prompts are written behind the shuffle.
    keyed = validation_set(spark, folder).select("id", "problem", seeded_digest(7, "id").alias("digest"))
    ranked = with_digest_rank(keyed, "digest", ["id"], "place")
    return problem_feed(ranked, "id", keep=["place"]).select("id", "text", "place")


@query
def prompt_render(spark, folder):
    return inputs.table(spark, folder, "documents").select(
        "doc_id", templates.prompt_text("text", prompt="Solve: {}\nHint: {}").alias("text")
    )


@query
def problem_fanout(spark, folder):
    problems = inputs.table(spark, folder, "documents").select(
        F.col("doc_id").alias("problem_id"), templates.prompt_text("text").alias("text")
    )
    return tracing.fan_out(problems, 4)


# --- chats -----------------------------------------------------------------


def _chat(spark, folder, template, task):
    return render_turns(inputs.turns(spark, folder), "conv_id", "turn", "role", "text", template, task)


@query
def chat_render_sft(spark, folder):
    return _chat(spark, folder, templates.PROBLEM_SOLUTION, "sft")


@query
def chat_render_generation(spark, folder):
    return _chat(spark, folder, templates.PROBLEM_SOLUTION, "generation")


@query
def chatml_render(spark, folder):
    return _chat(spark, folder, templates.choose_template(), "sft")


@query
def chatml_render_generation(spark, folder):
    return _chat(spark, folder, templates.choose_template(None, templates.CHATML), "generation")


def _messages(spark, folder, template, task):
    text = templates.chat_text("messages", template, task)
    return inputs.messages(spark, folder).select("doc_id", text.alias("text"))


@query
def messages_render_sft(spark, folder):
    return _messages(spark, folder, templates.PROBLEM_SOLUTION, "sft")


@query
def messages_render_generation(spark, folder):
    return _messages(spark, folder, templates.choose_template(), "generation")


@query
def config_render(spark, folder):
    """Arrays of turns by the template texts of the configurations, for training and for prompting."""
    rows = inputs.messages(spark, folder)
    configured = templates.choose_template(templates.PROBLEM_SOLUTION_TEXT)
    default = templates.choose_template(None, templates.CHATML_TEXT)
    return rows.select(
        "doc_id",
        templates.chat_text("messages", configured, "sft").alias("training"),
        templates.chat_text("messages", configured, "generation").alias("prompt"),
        templates.chat_text("messages", default, "generation").alias("default_prompt"),
    )


@query
def config_turns(spark, folder):
    """Turn tables of any length by a template text of a configuration."""
    return _chat(spark, folder, templates.choose_template(templates.PROBLEM_SOLUTION_TEXT), "generation")


@query
def messages_calibration(spark, folder):
    rows = inputs.messages(spark, folder).withColumn("problem", F.get("messages", F.lit(0))["content"])
    return draw_calibration(rows, "doc_id").select("doc_id", "text", "n_tokens")


@query
def messages_mask(spark, folder):
    masked = fields.mask_user_turns("messages")
    rows = inputs.messages(spark, folder).select("doc_id", F.explode(masked).alias("m"))
    return rows.select("doc_id", "m.role", "m.masked", F.length("m.content").alias("n_chars"))


@query
def calibration_sample(spark, folder):
    drawn = calibration_turns(inputs.turns(spark, folder), "conv_id", "turn", "role", "text")
    return drawn.select("conv_id", "text", "n_tokens")


@query
def user_turn_mask(spark, folder):
    return user_turns(inputs.turns(spark, folder), "conv_id", "role")


# --- answers ---------------------------------------------------------------


@query
def boxed_extract(spark, folder):
    return inputs.solutions(spark, folder).select("event_id", boxed_answer("solution").alias("boxed"))


@query
def answer_normalize(spark, folder):
    return with_clean_answer(inputs.solutions(spark, folder), "solution", "clean").select("event_id", "clean")


@query
def document_normalize(spark, folder):
    docs = inputs.busy_table(spark, folder, "documents", "doc_id", "text")
    return with_clean_answer(docs, "text", "clean").select("doc_id", "clean")


@query
def region_normalize(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", blocks.answer_region("text").alias("region"))
    return with_clean_answer(docs, "region", "clean").select("doc_id", "clean")


@query
def numeric_filter(spark, folder):
    rows = rejection.with_final_answer(inputs.solutions(spark, folder), "solution", "final")
    return rows.select("event_id", numeric_answer("final").alias("answer")).filter("answer is not null")


# --- mixing ----------------------------------------------------------------


def _mix(spark, folder, **options):
    docs = inputs.training_documents(spark, folder)
    return mixing.mix_tagged(docs, inputs.MIX_SPEC, "source", "split", "doc_id", **options)


def _mix_rows(spark, folder):
    docs = inputs.training_documents(spark, folder)
    rows = mixing.mix_tagged_rows(docs, inputs.MIX_SPEC, "source", "split", "doc_id")
    return rows.withColumnRenamed("kind", "split")


@query
def mix_fractions(spark, folder):
    return _mix_rows(spark, folder).select("split", "mix_pos", "row_key", "prompt")


@query
def mix_split_rows(spark, folder):
    return metrics.rows_per_split(_mix_rows(spark, folder))


def _named(spark, folder, chat):
    def read(name, split, revision):
        return inputs.named_dataset(spark, folder, name, split, revision, chat)

    return mixing.mix(inputs.NAMED_SPEC, read, "row_id", shuffle=False)


@query
def mix_named(spark, folder):
    """Several datasets with columns of their own, one of them in another revision."""
    rows = mixing.as_one(_named(spark, folder, False))
    return rows.select("split", "mix_pos", "row_key", "prompt", "completion", "score")


@query
def mix_rendered(spark, folder):
    rendered = mixing.render_mix(_named(spark, folder, True), templates.PROBLEM_SOLUTION)
    return mixing.as_one(rendered).select("split", "mix_pos", "row_key", "text")


@query
def file_prefix(spark, folder):
    """The first three tenths of a table as its files hold it; no order column is needed."""
    docs = inputs.table(spark, folder, "documents")
    files = file_rows(docs)
    kept = reader_prefix(docs, int(0.3 * sum(rows for _, rows in files)), files)
    return with_reader_place(kept, "place", files).select("place", "doc_id", "lang", "text")


@query
def revision_rows(spark, folder):
    """Two revisions of a dataset that share files, each read by its name."""
    root, rows = work_folder(spark, "sets"), inputs.table(spark, folder, "documents", "doc_id", "lang")
    commit_revision(spark, "org/notes", "v1", {"train": rows.filter("doc_id % 3 = 0"), "test": rows.filter("doc_id % 3 = 1")}, root)
    commit_revision(spark, "org/notes", "main", {"train": rows.filter("doc_id % 3 = 2")}, root, base="v1")
    found = [
        read_split(spark, "org/notes", split, revision, root).select(F.lit(revision).alias("revision"), F.lit(split).alias("split"), "doc_id", "lang")
        for revision in ("v1", "main")
        for split in ("train", "test")
    ]
    return reduce(DataFrame.unionAll, found)


@query
def mix_reader_order(spark, folder):
    """A mix of stored datasets by the library's reader, cut in the order of their files."""
    root = work_folder(spark, "sets")
    notes = inputs.table(spark, folder, "documents").orderBy("doc_id")
    notes = notes.select(F.col("text").alias("prompt"), F.col("lang").alias("completion"), "source", "doc_id")
    tests = notes.filter("doc_id % 10 = 0")
    commit_revision(spark, "notes", "main", {"train": notes.filter("doc_id % 10 <> 0"), "test": tests}, root)
    items = inputs.table(spark, folder, "benchmark").orderBy("item_id").select(F.col("text").alias("prompt"), "item_id")
    commit_revision(spark, "org/items", "v2", {"train": items, "test": items.filter("item_id % 7 = 0")}, root)

    def read(name, split, revision):
        return read_split(spark, name, split, revision, root)

    mixed = mixing.mix({"notes": 0.3, "org/items": {"fraction": 0.55, "revision": "v2"}}, read, shuffle=False)
    return mixing.as_one(mixed).select("split", "mix_pos", "row_key", "prompt", "completion")


@query
def mix_train_order(spark, folder):
    train = _mix(spark, folder, splits=["train"])["train"].select("mix_pos", "row_key", "digest")
    return with_digest_rank(train, "digest", ["mix_pos", "row_key"], "place")


@query
def seeded_shuffle_rank(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", seeded_digest(42, "doc_id").alias("digest"))
    return with_digest_rank(docs, "digest", ["doc_id"], "place").select("doc_id", "place")


@query
def sample_three(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return first_by_digest(docs, seeded_digest(3, "doc_id"), ["doc_id"], 3).select("doc_id", "text")


@query
def reported_samples(spark, folder):
    return inputs.training_documents(spark, folder).groupBy("split").agg(
        metrics.reported_samples().alias("n_all"), metrics.reported_samples(500).alias("n_reported")
    )


@query
def perplexity_metrics(spark, folder):
    losses = inputs.table(spark, folder, "events").select("event_type", (F.col("value") / 1000).alias("loss"))
    result = metrics.evaluation_metrics(losses, "event_type", "loss", 1500)
    return result.select(
        "event_type",
        "eval_samples",
        F.round("eval_loss", 6).alias("eval_loss"),
        F.round("perplexity", 6).alias("perplexity"),
    )


@query
def validation_split(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "source")
    return fields.with_validation_split(docs, "doc_id").groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


# --- traces ----------------------------------------------------------------


def _scored(spark, folder, restart_on_fail):
    return tracing.score_traces(
        inputs.traces(spark, folder),
        inputs.generations(spark, folder),
        inputs.executions(spark, folder),
        restart_on_fail=restart_on_fail,
    )


@query
def trace_scoring_restart(spark, folder):
    return _scored(spark, folder, True)


@query
def trace_scoring_prune(spark, folder):
    return _scored(spark, folder, False)


@query
def trace_vote_restart(spark, folder):
    return tracing.vote_traces(_scored(spark, folder, True))


@query
def trace_vote_prune(spark, folder):
    return tracing.vote_traces(_scored(spark, folder, False))


@query
def trace_scoring_long(spark, folder):
    """Traces of 64 steps, all completions of a trace in a row; the plan is that of any other number."""
    scored = tracing.score_lists(
        inputs.traces(spark, folder),
        inputs.generation_lists(spark, folder, LONG_STEPS),
        inputs.execution_lists(spark, folder, LONG_STEPS),
        LONG_STEPS,
    )
    text = F.col("gen_texts")
    return scored.select(
        "problem_id", "sample_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"), "model_answers", "has_code", "pruned_step"
    )


@query
def trace_survivors(spark, folder):
    """How many traces stop at each step; null are the survivors."""
    return _scored(spark, folder, False).groupBy("pruned_step").agg(F.count(F.lit(1)).alias("n_traces"))


@query
def code_block_stats(spark, folder):
    text = F.col("gen_texts")
    rows = _scored(spark, folder, False).withColumn("code", blocks.last_code_block(text))
    region = blocks.answer_region(text)
    return rows.select(
        "problem_id",
        "sample_id",
        blocks.code_block_count(text).alias("n_code"),
        blocks.output_block_count(text).alias("n_output"),
        region.alias("region"),
        blocks.asks_for_output(text).alias("asks"),
        blocks.states_answer(region).alias("states"),
        "code",
        blocks.uses_blocked_library("code").alias("blocked"),
    )


@query
def traceback_compact(spark, folder):
    rows = blocks.with_compact_traceback(inputs.runs(spark, folder), "stderr", "script", "report")
    return rows.select("event_id", "report")


@query
def execution_text(spark, folder):
    rows = blocks.with_execution_text(
        inputs.runs(spark, folder), "stdout", "success", "stderr", "script", "output"
    )
    return rows.select("event_id", blocks.append_output(F.lit("> "), "output").alias("shown"))


@query
def generated_answers(spark, folder):
    """Completions by a user function over Arrow batches of prompts."""

    def make():
        def count_lines(texts):
            return [f"There are {text.count(chr(10))} lines." for text in texts]

        return count_lines

    prompts = inputs.table(spark, folder, "documents").select("doc_id", templates.prompt_text("text").alias("text"))
    return prompts.select("doc_id", tracing.batched("text", make).alias("completion"))


@query
def live_scoring(spark, folder):
    """Two steps with user functions that see nothing but the text of a trace."""

    def make_generate():
        import re

        asked = re.compile(r"### Problem: (-?\d+) (\w+)")

        def go_on(texts):
            replies = []
            for text in texts:
                value, kind = asked.match(text).groups()
                if kind == "error":
                    replies.append("no program here")
                elif "```output" in text:
                    replies.append(f"\nThe answer is ${value}$.")
                else:
                    replies.append(f"```python\nprint({value})\n```\n```output\n")
            return replies

        return go_on

    def make_execute():
        import re

        printed = re.compile(r"print\((-?\d+)\)")
        return lambda programs: [printed.search(program)[1] for program in programs]

    return tracing.solve_live(inputs.live_traces(spark, folder), make_generate, make_execute, num_steps=2)


# --- sinks -----------------------------------------------------------------


@query
def stored_predictions(spark, folder):
    """The votes, written as predictions and read again."""
    path = work_folder(spark, "predictions")
    write_predictions(majority_vote(spark, folder), path, "problem_id")
    return spark.read.parquet(path)


@query
def logged_answers(spark, folder):
    """Problems answered one at a time, each with a commit of its own; the run breaks off twice and goes on."""
    feed = with_digest_rank(inputs.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", seeded_digest(5, F.col("s_suppkey")).alias("digest")), "digest", ["id"], "rank")
    feed = settle(feed.select("id", "s_acctbal", (F.col("rank") - 1).alias("place")))
    path = work_folder(spark, "answers")
    for most in (3, 4, None):
        AnswerLog(spark, path, feed).solve(lambda row: int(row["s_acctbal"]) % 1000, most)
    return settle(AnswerLog(spark, path, feed).answers().select("place", "id", "answer"))


@query
def stored_metrics(spark, folder):
    """The evaluation metrics, written as JSON and read again."""
    path = work_folder(spark, "metrics")
    rows = perplexity_metrics(spark, folder)
    write_metrics(rows, path)
    return spark.read.schema(rows.schema).json(path)


# --- rejection -------------------------------------------------------------


def _rejection_inputs(spark, folder):
    references = inputs.truth(spark, folder).select("problem_id", F.col("known").cast("string").alias("known"))
    return inputs.solutions(spark, folder), references


@query
def rejection_rounds(spark, folder):
    solutions, references = _rejection_inputs(spark, folder)
    accepted = rejection.rejection_rounds(solutions, references, "problem_id", "solution", "event_id", "known")
    return accepted.select("problem_id", "event_id", "round", "final_answer")


@query
def answer_match(spark, folder):
    solutions, references = _rejection_inputs(spark, folder)
    kept = rejection.matching_solutions(solutions, references, "problem_id", "solution", "event_id", "known")
    return kept.select("problem_id", "event_id", "final_answer")


@query
def generated_rounds(spark, folder):
    """Three rounds of two samples; a stand-in for a model is right from an attempt on that the problem tells."""

    def make():
        import re

        asked = re.compile(r"### Problem: (\d+) (-?\d+) (\d+)")

        def reply(texts):
            replies = []
            for text in texts:
                problem, known, attempt = (int(x) for x in asked.match(text).groups())
                replies.append(f"It is \\boxed{{{known if attempt >= problem % 7 else known + 1}}}.")
            return replies

        return reply

    def ask(text, number, sample):
        return templates.prompt_text(F.concat_ws(" ", text, (sample + 2 * number).cast("string")))

    problems = inputs.truth(spark, folder)
    text = F.concat_ws(" ", F.col("problem_id").cast("string"), F.col("known").cast("string"))
    references = problems.select("problem_id", F.col("known").cast("string").alias("known"))
    found = rejection.generate_rounds(
        problems.select("problem_id", text.alias("text")), references, "problem_id", "text", "known", make, rounds=3, samples=2, ask=ask
    )
    return found.select("problem_id", "round", "sample_id", "final_answer")


@query
def unsolved_problems(spark, folder):
    """Problems all rounds leave open."""
    solutions, references = _rejection_inputs(spark, folder)
    accepted = rejection.rejection_rounds(solutions, references, "problem_id", "solution", "event_id", "known")
    return rejection.unsolved(references, accepted, "problem_id").select("problem_id")


@query
def numeric_problems(spark, folder):
    rows = inputs.solutions(spark, folder).select("event_id", "solution")
    return rejection.numeric_problems(rows, "solution")


@query
def integer_problems(spark, folder):
    rows = inputs.candidates(spark, folder)
    return rejection.numeric_problems(rows, "answer", integer_only=True)


# --- tokens ----------------------------------------------------------------


@query
def token_count(spark, folder):
    docs = inputs.busy_table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", tokens.token_count("text").alias("n_tokens"))


@query
def token_truncate(spark, folder):
    docs = inputs.busy_table(spark, folder, "documents", "doc_id", "text")
    cut = tokens.effective_max_length(MAX_TOKENS)
    return docs.select(
        "doc_id",
        F.array_join(tokens.truncated_tokens("text", cut), " ").alias("head"),
        F.array_join(tokens.truncated_tokens("text", cut, "left"), " ").alias("tail"),
    )


@query
def pack_blocks(spark, folder):
    return pack(token_count(spark, folder), "doc_id", "n_tokens", BLOCK_SIZE)


@query
def packed_tokens(spark, folder):
    docs = inputs.busy_table(spark, folder, "documents", "doc_id", "text")
    sequences = docs.select("doc_id", tokens.tokens("text").alias("tokens"))
    placed = place_sequences(token_count(spark, folder), "doc_id", "n_tokens")
    filled = fill_blocks(placed, sequences, "doc_id", "tokens", BLOCK_SIZE)
    return filled.select("block_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("text"))


@query
def packed_mask(spark, folder):
    """Turns of all conversations packed into blocks, with a flag per token that says whether it is learnt."""
    content = F.coalesce("text", F.lit(""))
    turns = inputs.turns(spark, folder).select(
        F.struct("conv_id", "turn").alias("turn_key"),
        (F.col("role") != "user").alias("learnt"),
        templates.PROBLEM_SOLUTION.turn(F.col("role"), content).alias("text"),
    )
    sequences = encode_sequences(turns, "turn_key", "text", carry=["learnt"])
    placed = settle(place_sequences(sequences, "turn_key", "n_tokens", ["learnt"]))
    filled = fill_blocks(placed, sequences, "turn_key", "tokens", BLOCK_SIZE)
    mask = label_mask("n_tokens", "spans")
    labels = label_spans(placed, "turn_key", "learnt", BLOCK_SIZE).select("block_id", "n_tokens", mask.alias("mask"))
    shown = F.array_join(F.transform("mask", lambda learnt: learnt.cast("int").cast("string")), "")
    return filled.join(labels, "block_id").select("block_id", "n_tokens", F.array_join("tokens", " ").alias("text"), shown.alias("mask"))


@query
def encoded_blocks(spark, folder):
    """Documents packed by a user's tokenizer, which gives every word its length as its id."""

    def make():
        return lambda texts: [[len(word) for word in text.split(" ")] for text in texts]

    docs = inputs.busy_table(spark, folder, "documents", "doc_id", "text")
    blocks_ = pack_texts(docs, "doc_id", "text", BLOCK_SIZE, make)
    return blocks_.select("block_id", F.size("tokens").alias("n_tokens"), F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("ids"))


@query
def max_length_filter(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return fields.shorter_than(docs, "text", 128)


@query
def prompt_completion_pairs(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    pairs = fields.pair_columns(docs, "source", "text", "Topic: ")
    return pairs.select("doc_id", "prompt", "completion")


@query
def prompt_completion_cut(spark, folder):
    """With the lengths that a training set can declare."""
    docs = inputs.table(spark, folder, "documents")
    lengths = (fields.MAX_SOURCE_TOKENS, fields.MAX_TARGET_TOKENS)
    return fields.pair_columns(docs, "source", "text", "Topic: ", *lengths).select("doc_id", "prompt", "completion")


@query
def prediction_rows(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "lang")
    return fields.prediction_rows(docs, ["doc_id"], 50)


# --- streams ---------------------------------------------------------------


@query
def streamed_traces(spark, folder):
    """The votes over traces, whose prompts, completions and outputs arrive as files of three streams."""
    home = work_folder(spark, "steps")
    tables = {"prompts": inputs.traces(spark, folder), "generations": inputs.generations(spark, folder), "executions": inputs.executions(spark, folder)}
    streams = []
    for name, rows in tables.items():
        # Dealt by their hash: the steps of a trace lie in different files of a stream.
        rows.repartition(3, F.xxhash64(*rows.columns)).write.parquet(f"{home}/{name}")
        streams.append(open_stream(spark, rows.schema, f"{home}/{name}", max_files=2))
    start_scoring(step_stream(*streams), f"{home}/scored", f"{home}/progress").awaitTermination()
    return votes_so_far(spark, f"{home}/scored")


@query
def incremental_vote(spark, folder):
    """The majority vote, fed by a stream of event files."""
    schema = inputs.table(spark, folder, "events").schema
    # As a glob the path may be a file as well as a folder of files.
    stream = open_stream(spark, schema, f"{folder}/events.parque[t]", max_files=100)

    def prepare(batch):
        answer = F.when(F.col("event_type") == "error", "-1").otherwise(F.col("value").cast("string"))
        return batch.select(
            F.col("user_id").alias("problem_id"), "event_id", numeric_answer(answer).alias("candidate")
        )

    home = work_folder(spark, "tally")
    running = start_tally(
        stream, prepare, f"{home}/counts", f"{home}/progress", "problem_id", "candidate", "event_id"
    )
    running.awaitTermination()
    return current_votes(spark, f"{home}/counts", "problem_id", "candidate")
