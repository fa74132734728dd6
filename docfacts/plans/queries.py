"""The registered queries: each reads the given tables and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F

from docfacts.functions import composition as C
from docfacts.functions.jsontext import json_kind, json_size, light_fix as fix_json
from docfacts.functions.sql import each_value, let
from docfacts.operators import compositions, documents, labels, prompts, records, requests, responses, text_budget, verdicts
from docfacts.operators.grouping import previous_in_group
from docfacts.plans import fixtures as fx
from docfacts.session import work_folder
from docfacts.sources import files, sinks
from docfacts.streaming import ingest

PROMPT = "Read the PDF file and extract the alloys."
INSTRUCTION = "Answer yes or no for each extracted material."
DIVISOR = 750
LIST_SIZE = 8


def _places(value: Column, places: int = 6) -> Column:
    return F.round(value, places)


def _long(df: DataFrame, keys: list[str], amounts: str, value: str = "amount") -> DataFrame:
    """A composition map as rows; one row with nulls where there is none."""
    rows = df.select(*keys, F.explode_outer(amounts).alias("element", "_v"))
    return rows.withColumn(value, _places(F.col("_v"))).drop("_v")


# ---- compositions ----

def _alloys(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.ALLOYS)


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    """All composition texts: ``rec_id, source, txt``."""
    alloys = _alloys(spark, d).select(
        "rec_id",
        F.stack(
            F.lit(3),
            F.lit("name"), F.col("name"),
            F.lit("nominal"), F.col("nominal_composition"),
            F.lit("measured"), F.col("measured_composition"),
        ).alias("source", "txt"),
    )
    odd = fx.derived(spark, d, fx.ODD_SPELLINGS).select("rec_id", F.lit("odd").alias("source"), F.col("spelling").alias("txt"))
    return alloys.unionAll(odd)


def parse_formula(spark: SparkSession, d: str) -> DataFrame:
    """Composition spellings and whole document texts, read as formulas."""
    texts = fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("rec_id"), F.lit("document").alias("source"), F.col("text").alias("txt")
    )
    parsed = _spellings(spark, d).unionAll(texts).withColumn("m", F.expr(C.parse_formula(C.clean_text("txt"))))
    return _long(parsed, ["rec_id", "source"], "m")


def parse_ratio_form(spark: SparkSession, d: str) -> DataFrame:
    parsed = _spellings(spark, d).withColumn("m", F.expr(let(C.clean_text("txt"), C.parse_ratio_form)))
    return _long(parsed, ["rec_id", "source"], "m")


def parse_pairs(spark: SparkSession, d: str) -> DataFrame:
    parsed = _spellings(spark, d).withColumn("p", F.expr(let(C.clean_text("txt"), C.parse_pairs)))
    return _long(parsed, ["rec_id", "source", "p.unit"], "p.amounts")


def parse_composition(spark: SparkSession, d: str) -> DataFrame:
    parsed = _spellings(spark, d).withColumn("p", F.expr(C.parse_composition("txt")))
    return _long(parsed, ["rec_id", "source", "p.unit"], "p.amounts")


def normalize_composition(spark: SparkSession, d: str) -> DataFrame:
    done = compositions.parse_and_normalize(_spellings(spark, d), "txt", "c")
    return _long(done, ["rec_id", "source"], "c_fractions", "fraction")


def normalize_as_weight(spark: SparkSession, d: str) -> DataFrame:
    """Compositions without a unit read as weight percent."""
    done = compositions.parse_and_normalize(_spellings(spark, d), "txt", "c", assume_weight_if_ambiguous=True)
    return _long(done, ["rec_id", "source"], "c_fractions", "fraction")


def weight_to_mole(spark: SparkSession, d: str) -> DataFrame:
    """Moles of all compositions that state weight percent."""
    parsed = _spellings(spark, d).withColumn("p", F.expr(C.parse_composition("txt"))).where(F.col("p.unit") == "wt")
    return _long(parsed.withColumn("m", F.expr(C.weight_to_mole("p.amounts"))), ["rec_id", "source"], "m", "moles")


def name_inferred(spark: SparkSession, d: str) -> DataFrame:
    named = _spellings(spark, d).withColumn("m", F.expr(C.infer_from_name("txt")))
    return _long(named, ["rec_id", "source"], "m", "fraction")


def parse_strict(spark: SparkSession, d: str) -> DataFrame:
    """Compositions that are understood as a whole or reported."""
    done = compositions.parse_and_normalize(fx.derived(spark, d, fx.STRICT_SPELLINGS), "spelling", "c", strict=True)
    return done.select(
        "rec_id", "spelling", F.expr(C.sorted_json("c_parsed")).alias("amounts"), F.col("c_unit").alias("unit"),
        F.array_join("c_problems", "¦").alias("problems"),
    )


def check_strict(spark: SparkSession, d: str) -> DataFrame:
    """The whole check on compositions that must be understood as a whole."""
    checked = compositions.check_compositions(_alloys(spark, d), strict=True)
    return checked.select("rec_id", "consistency_check", *[F.array_join(f"{side}_problems", "¦").alias(f"{side}_problems") for side in ("nominal", "measured")])


def _compared(spark: SparkSession, d: str) -> DataFrame:
    work = compositions.parse_and_normalize(_alloys(spark, d), "nominal_composition", "nominal")
    work = compositions.parse_and_normalize(work, "measured_composition", "measured")
    return compositions.compare_compositions(work.withColumn("name_fractions", F.expr(C.infer_from_name("name"))))


def composition_distance(spark: SparkSession, d: str) -> DataFrame:
    measures = ["l1_nom_vs_name", "l1_nom_vs_measured", "cos_nom_vs_name", "cos_nom_vs_measured"]
    return _compared(spark, d).select("rec_id", *[_places(F.col(m)).alias(m) for m in measures])


def ratio_string(spark: SparkSession, d: str) -> DataFrame:
    work = compositions.parse_and_normalize(_alloys(spark, d), "nominal_composition", "nominal")
    return work.withColumn("o", F.expr(C.element_order("name"))).select(
        "rec_id",
        F.expr(C.ratio_string("nominal_fractions", "o")).alias("ratio_text"),
        F.expr(C.ratio_string("nominal_fractions", "o", decimals=3)).alias("ratio_text_3"),
    )


def name_without_zero(spark: SparkSession, d: str) -> DataFrame:
    work = compositions.parse_and_normalize(_alloys(spark, d), "nominal_composition", "nominal")
    return work.withColumn("o", F.expr(C.element_order("name"))).select(
        "rec_id", F.expr(C.name_without_zero("name", "nominal_fractions", "o")).alias("name_without_zero")
    )


def check_compositions(spark: SparkSession, d: str) -> DataFrame:
    checked = compositions.check_compositions(_alloys(spark, d), as_json=False)
    maps = ["nominal_parsed", "nominal_molar_fractions", "name_inferred_equal_molar", "measured_parsed", "measured_molar_fractions"]
    measures = ["l1_nom_vs_name", "l1_nom_vs_measured", "cos_nom_vs_name", "cos_nom_vs_measured"]
    return checked.select(
        "rec_id", "name", "nominal_composition", "measured_composition",
        *[F.expr(C.sorted_json(each_value(m, lambda v: f"round({v}, 6)"))).alias(m) for m in maps],
        *[_places(F.col(m)).alias(m) for m in measures],
        "consistency_check", "name_without_zero", F.col("cleanned composition"),
    )


def check_headers(spark: SparkSession, d: str) -> DataFrame:
    """The same check over a table with other spellings of its headers, and an extra column."""
    spelled = {"name": "Name", "nominal_composition": "Nominal Composition", "measured_composition": "MEASURED_composition"}
    renamed = _alloys(spark, d).withColumnsRenamed(spelled).withColumn("Note", F.lit("x"))
    return compositions.check_compositions(renamed).select("rec_id", "consistency_check", "name_without_zero", "Note")


def consistency_summary(spark: SparkSession, d: str) -> DataFrame:
    return compositions.consistency_summary(_compared(spark, d))


# ---- answers and records ----

def _answers(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.RESPONSES)


def parse_v1(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse_v1(_answers(spark, d)).select("doc_id", "status", "branch", F.to_json("json").alias("json"))


def parse_v2(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse_v2(_answers(spark, d)).select(
        "doc_id", "status", "candidate_no", "repaired",
        F.expr(json_kind("json")).alias("kind"), F.expr(json_size("json")).alias("size"), F.to_json("json").alias("json"),
    )


def json_candidates(spark: SparkSession, d: str) -> DataFrame:
    return responses.candidate_rows(_answers(spark, d))


def json_candidates_pages(spark: SparkSession, d: str) -> DataFrame:
    """Balanced chunks in whole web pages."""
    return responses.candidate_rows(fx.table(spark, d, "pages"), "page_id", "html")


def json_candidates_two(spark: SparkSession, d: str) -> DataFrame:
    """At most two balanced chunks of each bracket type."""
    return responses.candidate_rows(_answers(spark, d), max_items=2)


def light_fix(spark: SparkSession, d: str) -> DataFrame:
    answers = _answers(spark, d).select(
        F.lit("answer").alias("source"), F.col("doc_id").alias("row_id"), F.translate("response", '"', "'").alias("txt")
    )
    pages = fx.table(spark, d, "pages").select(F.lit("page"), "page_id", "html")
    return answers.unionAll(pages).select("source", "row_id", F.expr(fix_json("txt")).alias("fixed"))


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Answers without JSON and record files that are no list, with their whole text."""
    answers = responses.quarantine(responses.parse_v2(_answers(spark, d))).select(
        F.col("doc_id").cast("string").alias("item"), "reason", "raw"
    )
    return answers.unionAll(records.file_issues(fx.derived(spark, d, fx.RECORD_FILES)))


def _records(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_record_files(fx.derived(spark, d, fx.RECORD_FILES))
    return records.flatten_records(parsed, "Paperid", placeholder=records.NOT_FOUND, accept_object=True)


def flatten_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)


def combine_records(spark: SparkSession, d: str) -> DataFrame:
    return records.combine_records(fx.derived(spark, d, fx.RECORD_FILES))


def combine_all_keys(spark: SparkSession, d: str) -> DataFrame:
    return records.combine_all_keys(fx.derived(spark, d, fx.RECORD_FILES))


def combine_with_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = [
        "name", "nominal_composition", "measured_composition", "lattice_constant", "phases", "doi",
        "confidence_scores", "is_single_phase",
    ]
    return records.combine_with_keys(fx.derived(spark, d, fx.RECORD_FILES), keys)


def combine_wide(spark: SparkSession, d: str) -> DataFrame:
    """All keys of all records as typed columns."""
    return records.combine_wide(fx.derived(spark, d, fx.MIXED_FILES))


def record_keys(spark: SparkSession, d: str) -> DataFrame:
    return records.record_keys(fx.derived(spark, d, fx.RECORD_FILES))


def confidence_profile(spark: SparkSession, d: str) -> DataFrame:
    profile = records.confidence_profile(_records(spark, d))
    return profile.withColumn("high_share", _places(F.col("high_share")))


# ---- text and token budgets ----

def _stats(spark: SparkSession, d: str) -> DataFrame:
    pages = (F.lit(1) + F.floor(F.col("n_chars") / 3000)).cast("int")
    return text_budget.text_stats(fx.table(spark, d, "documents"), pages=pages, engine=F.lit("table"))


def text_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


def _megapixels(spark: SparkSession, d: str) -> DataFrame:
    return text_budget.image_megapixels(_stats(spark, d), fx.derived(spark, d, fx.PAGE_GEOMETRY))


def _budget(spark: SparkSession, d: str) -> DataFrame:
    return text_budget.token_budget(_megapixels(spark, d), image_divisor=DIVISOR)


def image_megapixels(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").select(
        "doc_id", (F.lit(1) + F.floor(F.col("n_chars") / 3000)).cast("int").alias("pages")
    )
    sized = text_budget.image_megapixels(docs, fx.derived(spark, d, fx.PAGE_GEOMETRY), default_size="a4")
    return sized.withColumn("image_mp", _places(F.col("image_mp")))


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return _budget(spark, d).withColumn("image_mp", _places(F.col("image_mp")))


def token_budget_rate(spark: SparkSession, d: str) -> DataFrame:
    """The same with a rate per megapixel."""
    return text_budget.token_budget(_megapixels(spark, d), image_tokens_per_mp=1334.0).select(
        "doc_id", "image_tokens", "total_tokens_word_est", "total_tokens_char_est", "total_tokens_tiktoken"
    )


def token_report(spark: SparkSession, d: str) -> DataFrame:
    return text_budget.token_report(_budget(spark, d))


def token_budget_csv(spark: SparkSession, d: str) -> DataFrame:
    return text_budget.token_budget_csv(_budget(spark, d))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return text_budget.token_totals(_budget(spark, d)).withColumn("image_mp", _places(F.col("image_mp"), 4))


def text_stats_edited(spark: SparkSession, d: str) -> DataFrame:
    """Texts with split words and runs of blanks; failed extractions are left out."""
    return text_budget.text_stats(fx.derived(spark, d, fx.EDITED_TEXTS)).select("doc_id", "characters", "words", "tokens_word_est", "tokens_char_est")


def text_failures(spark: SparkSession, d: str) -> DataFrame:
    return text_budget.text_failures(fx.derived(spark, d, fx.EDITED_TEXTS))


def token_budget_no_images(spark: SparkSession, d: str) -> DataFrame:
    """A run without images: their columns stay null."""
    return text_budget.without_images(_stats(spark, d))


def token_budget_no_rate(spark: SparkSession, d: str) -> DataFrame:
    """Images measured in a page size of one's own at 100 dpi, with neither divisor nor rate."""
    sized = text_budget.image_megapixels(
        _stats(spark, d), fx.derived(spark, d, fx.PAGE_GEOMETRY), dpi=100, default_width=5.0, default_height=7.0
    )
    budget = text_budget.token_budget(sized)
    return budget.withColumn("image_mp", _places(F.col("image_mp")))


def token_total_line(spark: SparkSession, d: str) -> DataFrame:
    """The total line with and without images."""
    lines = [text_budget.token_total_line(text_budget.token_totals(b)) for b in (_budget(spark, d), text_budget.without_images(_stats(spark, d)))]
    return lines[0].select(F.lit("images").alias("run"), "line").unionAll(lines[1].select(F.lit("plain"), "line"))


def text_source_pick(spark: SparkSession, d: str) -> DataFrame:
    return documents.pick_text(fx.derived(spark, d, fx.BACKEND_TEXTS)).select("doc_id", "text", "pages", "engine")


# ---- prompts, labels, verdicts ----

def prompt_similarity(spark: SparkSession, d: str) -> DataFrame:
    scored = prompts.prompt_similarity(fx.derived(spark, d, fx.PROMPT_HISTORY))
    return scored.withColumn("similarity", _places(F.col("similarity")))


def prompt_log(spark: SparkSession, d: str) -> DataFrame:
    return prompts.parse_prompt_log(fx.derived(spark, d, fx.PROMPT_LOGS))


def _label_records(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_records(fx.derived(spark, d, fx.LABEL_FILE), keep=("rec_id", "Paperid"))


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Lists of few records, so that papers are cut into pieces at any size of the tables."""
    sets = labels.label_sets(_label_records(spark, d), "rec_id", folder="papers/", list_size=LIST_SIZE)
    return sets.withColumn("records", F.to_json("records", {"ignoreNullFields": "false"}))


def _mix(item: Column, epoch: Column) -> Column:
    return (item * 7919 + epoch * 104729) % 1000003


def mini_batches(spark: SparkSession, d: str) -> DataFrame:
    return labels.mini_batches(fx.table(spark, d, "documents"), mix=_mix, mix_range=1000003)


def batch_feedback(spark: SparkSession, d: str) -> DataFrame:
    judged = fx.derived(spark, d, fx.VERDICTS)
    batches = labels.mini_batches(fx.table(spark, d, "labels"), mix=_mix, mix_range=1000003)
    return verdicts.batch_feedback(batches, judged)


def label_reconcile(spark: SparkSession, d: str) -> DataFrame:
    lattice = ((F.lit(3000) + F.col("lattice_milli")) / 1000).alias("lattice_constant")
    predicted = _alloys(spark, d).select("paper_id", "name", lattice)
    labelled = _label_records(spark, d).select(F.col("Paperid").alias("paper_id"), "name", "lattice_constant")
    return labels.label_reconcile(predicted, labelled)


def _near_constants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sides = fx.derived(spark, d, fx.NEAR_CONSTANTS)
    return sides.where("side = 'predicted'"), sides.where("side = 'labelled'")


def label_reconcile_tol(spark: SparkSession, d: str) -> DataFrame:
    """Labels compared under a tolerance, constants a few tolerances apart."""
    return labels.label_reconcile_within(*_near_constants(spark, d))


def reconcile_chains(spark: SparkSession, d: str) -> DataFrame:
    """The same, chain by chain, under a wider tolerance."""
    return labels.reconcile_chains(*_near_constants(spark, d), tolerance=7e-4)


def verdict_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = verdicts.verdict_scores(fx.derived(spark, d, fx.VERDICTS))
    return scores.withColumn("good_rate", _places(F.col("good_rate")))


# ---- documents and requests ----

def scan_docs(spark: SparkSession, d: str) -> DataFrame:
    return documents.both_scans(fx.derived(spark, d, fx.PATHS), "/in")


def _binary_docs(spark: SparkSession, d: str) -> DataFrame:
    head = F.expr(
        "case doc_id % 4 when 0 then X'255044462D312E37' when 1 then X'FFD8FFE0' "
        "when 2 then X'89504E470D0A1A0A' else X'00' end"
    )
    return fx.table(spark, d, "documents").select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))


def classify_docs(spark: SparkSession, d: str) -> DataFrame:
    return documents.classify_docs(_binary_docs(spark, d)).select("doc_id", "kind", "is_pdf")


def pending_docs(spark: SparkSession, d: str) -> DataFrame:
    outcomes = fx.table(spark, d, "labels")
    results = outcomes.where(F.col("quality") == 1)
    raw = outcomes.where(F.col("quality") == 0)
    return documents.pending_docs(fx.table(spark, d, "documents").select("doc_id", "source"), results, raw)


def pair_outputs(spark: SparkSession, d: str) -> DataFrame:
    outputs = fx.table(spark, d, "labels").select(F.format_string("/out/%d.v1.json", "doc_id").alias("path"), "quality")
    suffix = F.when(F.col("lang") == "fr", ".PDF").otherwise(".pdf")
    pdfs = fx.table(spark, d, "documents").select(F.concat(F.format_string("/out/%d.v1", "doc_id"), suffix).alias("path"))
    return documents.pair_outputs(outputs, pdfs)


def request_rows(spark: SparkSession, d: str) -> DataFrame:
    """Extraction, judge and training requests, each also for the documents that are rejected."""
    answers = _answers(spark, d).withColumnRenamed("response", "answer")
    truths = label_sets(spark, d).select(F.col("Paperid").alias("doc_id"), F.col("records").alias("truth"), "list_no", "n_lists")
    return requests.all_requests(_binary_docs(spark, d), answers, truths, PROMPT, INSTRUCTION)


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the incremental ingest over the same answers; the second one adds nothing."""
    schema = spark.read.parquet(f"{d}/part.parquet").schema
    outcomes, first, second = (work_folder(spark, p) for p in ("outcomes", "stream", "stream"))
    for checkpoint in (first, second):
        arriving = spark.readStream.schema(schema).parquet(f"{d}/part*.parquet")
        answers = spark.sql(fx.RESPONSES, part=arriving)
        ingest.ingest_answers(answers, outcomes, checkpoint).awaitTermination()
    return ingest.read_outcomes(spark, outcomes).select("doc_id", "status", "candidate_no", "repaired", "json", "raw")


# ---- positions, readers and writers: tables written to the shared folder and read back ----

def sorted_records(spark: SparkSession, d: str) -> DataFrame:
    return records.sorted_records(fx.derived(spark, d, fx.RECORD_FILES))


def sorted_pdfs(spark: SparkSession, d: str) -> DataFrame:
    return documents.sorted_pdfs(fx.derived(spark, d, fx.PATHS))


def _a_file_each(rows: DataFrame) -> DataFrameWriter:
    """A writer of one file for each row. A file costs far more than its bytes, so rows are dealt over all shuffle partitions, however small the table."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.write.option("maxRecordsPerFile", 1)


def scan_folders(spark: SparkSession, d: str) -> DataFrame:
    """A folder with a PDF for each supplier, and more files in it and below it, scanned flat; folders by nation, scanned at any depth, named twice."""
    folder, nations = work_folder(spark, "pdfs"), work_folder(spark, "nations")
    suppliers = fx.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.format_string("%%PDF-%d", "s_suppkey").alias("line"))
    flat, deep = suppliers.select("line"), suppliers.select("line", F.col("s_nationkey").alias("nation"))
    _a_file_each(flat).option("extension", "pdf").csv(folder)
    flat.write.mode("append").text(folder)
    flat.write.option("extension", "pdf").csv(f"{folder}/below")
    _a_file_each(deep).option("extension", "PDF").partitionBy("nation").csv(nations)
    top = files.scan_pdfs(spark, folder).where("length > 0").select(
        F.lit("flat").alias("scan"), F.btrim(F.col("content").cast("string"), F.lit("\n")).alias("found"),
        F.lit(1).cast("long").alias("n"), F.startswith(F.substring_index("path", "/", -1), F.concat("doc_id", F.lit("."))).alias("good"),
    )
    below = files.scan_pdfs_recursive(spark, [nations, nations]).select(F.lit("all").alias("scan"), "position", F.struct("path", "position").alias("at"))
    # Positions are right if the first is 0 and each next one stands by 1 later, at a greater path.
    before, path = F.col("previous"), F.col("at.path")
    follows = F.when(before.isNull(), F.col("position") == 0).otherwise((F.col("position") == before["position"] + 1) & (path > before["path"]))
    by_nation = previous_in_group(below, "scan", "position", "at", block=65_536).groupBy(F.regexp_extract(path, r"nation=(\d+)", 1).alias("found"))
    return top.unionAll(by_nation.agg(F.count(F.lit(1)).alias("n"), F.bool_and(follows).alias("good")).select(F.lit("recursive"), "found", "n", "good"))


def record_folder(spark: SparkSession, d: str) -> DataFrame:
    """One JSON file for each paper, its first record, read as record files."""
    folder = work_folder(spark, "records")
    lattice = (F.lit(3) + F.col("lattice_milli") / 1000).alias("lattice_constant")
    first = _alloys(spark, d).groupBy("paper_id").agg(F.min(F.struct("rec_id", "name", lattice, F.col("paper_id").cast("string").alias("doi"))).alias("r"))
    _a_file_each(first.select("r.name", "r.lattice_constant", "r.doi")).json(folder)
    read = files.read_record_files(spark, folder).where("value <> ''")
    parsed = records.parse_record_files(read)
    rows = records.flatten_records(parsed, "issue", accept_object=True)
    return rows.select("issue", "pos", "name", "lattice_constant", "doi")


def outcomes_written(spark: SparkSession, d: str) -> DataFrame:
    """Parsed answers of one run, written twice, and of half of them in another run."""
    folder = work_folder(spark, "outcomes")
    parsed = responses.parse_v2(_answers(spark, d))
    for run_id in ("a", "a", "b"):
        sinks.write_outcomes(parsed, folder, run_id)
    results = sinks.read_results(spark, folder).select("doc_id", "json", F.lit(None).cast("string").alias("raw"), F.lit("ok").alias("kind"))
    return results.unionAll(sinks.read_quarantine(spark, folder).select("doc_id", F.lit(None).cast("string"), "raw", "reason"))


def csv_written(spark: SparkSession, d: str) -> DataFrame:
    """The combined table written as CSV and read back with its types."""
    folder = work_folder(spark, "csv")
    combined = combine_records(spark, d)
    sinks.write_csv(combined, folder)
    return files.read_table(spark, folder, schema=combined.schema)


def csv_split(spark: SparkSession, d: str) -> DataFrame:
    """Cells with line ends, quotes and commas, read in byte ranges, types inferred."""
    folder = work_folder(spark, "csv")
    sinks.write_csv(fx.derived(spark, d, fx.TABLE_CELLS), folder)
    return files.read_split_table(spark, folder, infer=True)


def verdicts_written(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of two runs, the first written twice, as answers."""
    folder = work_folder(spark, "verdicts")
    judged = fx.derived(spark, d, fx.VERDICTS)
    for run_id in ("first", "first", "second"):
        sinks.write_verdicts(judged, folder, run_id)
    return spark.read.parquet(folder).groupBy("doc_id", "verdict_text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"))


def prompt_log_files(spark: SparkSession, d: str) -> DataFrame:
    """All logs in one file, read in byte ranges."""
    folder = work_folder(spark, "logs")
    logs = fx.derived(spark, d, fx.PROMPT_LOGS)
    logs.coalesce(1).sortWithinPartitions("log_id").select("value").write.text(folder)
    return files.read_prompt_logs(spark, folder).drop("log_id")


def parse_v2_non_finite(spark: SparkSession, d: str) -> DataFrame:
    """Answers with NaN and Infinity, and the numbers that typed columns read."""
    parsed = responses.parse_v2(fx.derived(spark, d, fx.NON_FINITE), non_finite=True)
    first = F.try_variant_get("json", "$[0]", "variant")
    lattice = records.record_columns(first)[records.FIELDS.index("lattice_constant")]
    return parsed.select("doc_id", F.to_json("json").alias("json"), lattice.cast("string").alias("lattice"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_stats, token_totals, image_megapixels, token_budget, token_budget_rate, token_report,
        token_budget_csv, text_source_pick, text_stats_edited, text_failures, token_budget_no_images,
        token_budget_no_rate, token_total_line, normalize_as_weight,
        parse_formula, parse_ratio_form, parse_pairs, parse_composition, normalize_composition,
        weight_to_mole, name_inferred, composition_distance, ratio_string, name_without_zero,
        check_compositions, check_headers, consistency_summary, parse_strict, check_strict,
        parse_v1, json_candidates, json_candidates_two, json_candidates_pages, light_fix, parse_v2, quarantine,
        flatten_records, confidence_profile, combine_records, combine_all_keys, combine_with_keys, combine_wide, record_keys,
        prompt_similarity, prompt_log, label_sets, mini_batches, batch_feedback, label_reconcile, label_reconcile_tol, reconcile_chains,
        verdict_scores,
        scan_docs, classify_docs, pending_docs, pair_outputs, request_rows, stream_ingest,
        sorted_records, sorted_pdfs, scan_folders, record_folder, outcomes_written, csv_written, csv_split, verdicts_written,
        prompt_log_files, parse_v2_non_finite,
    )
}
