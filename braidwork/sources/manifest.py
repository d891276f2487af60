"""Manifest tables: fixed schema, JSON array or JSON lines, validation profiles, sidecars and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions import columns as C

# The manifest's fields, version and row profiles.
VERSION = "corpus_manifest_v1"
_KINDS = {"cs_density": "double", "lang_tags": "array<string>", "duration_s": "double", "is_synthetic": "boolean", "flags": "array<string>", "speed": "double", "chunks": "array<string>", "filter_recall": "double", "filter_cer_roman": "double", "filter_wer_raw": "double", "rep_4gram": "double", "accept": "boolean", "regen_attempt": "int"}
REQUIRED = "utt_id audio_path ref_orig ref_surface ref_iso15919 cmi_bin cs_density lang_tags speaker_id duration_s sha256 dataset partition is_synthetic license flags schema_version".split()
OPTIONAL = "corpus_id speed temp_tier teacher chunks asr_hyp filter_recall filter_cer_roman filter_wer_raw rep_4gram accept reject_reason regen_attempt".split()
_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}
SCHEMA = T.StructType([T.StructField(c, _TYPES[_KINDS.get(c, "string")]) for c in [*REQUIRED, *OPTIONAL]])
BINS = ("none", "low", "med", "high")


def conform(df: DataFrame) -> DataFrame:
    """Rows of the manifest schema: unknown columns and missing required ones are errors, optional ones default."""
    unknown, missing = {*df.columns} - {*SCHEMA.names}, {*REQUIRED} - {*df.columns} - {"schema_version"}
    if unknown or missing:
        raise ValueError(f"unknown columns {sorted(unknown)}, missing columns {sorted(missing)}")
    defaults = {"schema_version": F.lit(VERSION), "regen_attempt": F.lit(0)}
    pick = lambda f: F.coalesce(*([F.col(f.name)] if f.name in df.columns else []), defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
    return df.select(*map(pick, SCHEMA.fields))


def problems(needed: tuple[str, ...] = ("utt_id", "ref_orig")) -> Column:
    """What is wrong with a row, as a list of sentences."""
    checks = [F.when(F.col(c).isNull(), f"{c} is null") for c in needed]
    checks += [
        F.when(F.col("schema_version") != VERSION, "schema_version is unknown"),
        F.when(F.col("cmi_bin").isNotNull() & ~F.col("cmi_bin").isin(*BINS), "cmi_bin is unknown"),
        F.when(F.col("is_synthetic").isNull(), "is_synthetic is null"),
        F.when(F.exists("lang_tags", lambda t: ~t.isin("hi", "en", "other")), "lang_tags has an unknown tag"),
    ]
    return F.array_compact(F.array(*checks))


def starts_with_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that isn't blank is a bracket."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(lines) and lines[0][0].lstrip().startswith("[")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """JSON array or JSON lines; missing or empty files give no rows."""
    try:
        multi = starts_with_array(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=multi)


def write_manifest(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines under the committer's protocol, so readers never see half a write."""
    df.write.mode("append" if append else "overwrite").json(path, ignoreNullFields=False)


def write_array(df: DataFrame, path: str) -> None:
    """One file with one JSON array, for manifests of a single machine's size."""
    whole = df.agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


PROMPT = "text string, ref_surface string, domain string, cs_mode string, source string"


def read_prompts(spark: SparkSession, glob: str) -> DataFrame:
    """Prompt lines of several files; blank, malformed and empty ones skipped, domain and source from the file's name."""
    raw = spark.read.schema(f"{PROMPT}, _bad string").json(glob, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.[^.]*$", "")
    rows = raw.select("*", stem.alias("_stem")).where("_bad is null and trim(text) <> ''")
    return rows.select(F.trim("text").alias("text"), "ref_surface", F.coalesce("domain", "_stem").alias("domain"), "cs_mode", F.coalesce("source", "_stem").alias("source"))


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, hyp) of a JSON array, JSON lines, or an object from id to text or to an object with the text."""
    hyp = lambda c: F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("hyp_deva", "asr_hyp", "hyp", "text")])
    whole = spark.read.text(path, wholetext=True).where("trim(value) <> ''")
    trimmed = F.ltrim("value")
    is_array, one = F.left(trimmed, F.lit(1)) == "[", F.try_parse_json("value")
    listed = whole.where(is_array).select(F.explode(F.from_json("value", "array<string>")).alias("r"))
    object_ = whole.where(~is_array & one.isNotNull() & F.get_json_object("value", "$.utt_id").isNull())
    pairs = object_.select(F.explode(F.from_json("value", "map<string,string>")).alias("utt_id", "v")).select("utt_id", F.when(F.left("v", F.lit(1)) == "{", hyp(F.col("v"))).otherwise(F.col("v")).alias("hyp"))
    lines = whole.where(~is_array & (one.isNull() | F.get_json_object("value", "$.utt_id").isNotNull())).select(F.explode(F.split("value", "\n")).alias("r"))
    rows = listed.unionByName(lines).where("trim(r) <> ''").select(F.get_json_object("r", "$.utt_id").alias("utt_id"), hyp(F.col("r")).alias("hyp"))
    return rows.unionByName(pairs).where("utt_id is not null")


def read_scores(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(utt_id, value) of a score file's rows; null values dropped, the last of a repeated id wins."""
    rows = spark.read.json(path, multiLine=True).select(F.posexplode("rows").alias("pos", "r"))
    return rows.where(F.col(f"r.{key}").isNotNull()).groupBy(F.col("r.utt_id").alias("utt_id")).agg(F.max_by(f"r.{key}", "pos").alias("value"))


def read_piped(spark: SparkSession, path: str, columns: str = "audio string, text string, speaker string") -> DataFrame:
    """Pipe-separated rows of three columns or more; short rows and blank texts skipped."""
    parts = spark.read.text(path).select(F.split("value", r"\|").alias("p")).where(F.size("p") >= 3)
    names = [c.split()[0] for c in columns.split(", ")]
    return parts.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)]).where("trim(text) <> ''")


def write_piped(df: DataFrame, path: str) -> None:
    flat = [F.translate(F.col(c).cast("string"), "|\n", "  ").alias(c) for c in df.columns]
    df.select(F.concat_ws("|", *flat).alias("value")).write.mode("overwrite").text(path)


def write_kaldi(df: DataFrame, path: str) -> None:
    """wav.scp, text, utt2spk, spk2utt and domain.scp, in order of utterance, and the rows themselves."""
    pair = lambda a, b: F.concat_ws(" ", a, b).alias("value")
    rows = df.select("utt_id", "audio_path", "ref_orig", "speaker_id", "domain")
    for name, column in (("wav.scp", "audio_path"), ("text", "ref_orig"), ("utt2spk", "speaker_id"), ("domain.scp", "domain")):
        rows.orderBy("utt_id").select(pair("utt_id", F.coalesce(F.col(column), F.lit("")))).write.mode("overwrite").text(f"{path}/{name}")
    speakers = rows.groupBy("speaker_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("utt_id"))).alias("u"))
    speakers.orderBy("speaker_id").select(pair("speaker_id", "u")).write.mode("overwrite").text(f"{path}/spk2utt")
    write_manifest(df, f"{path}/manifest")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(ord, deva, roman, n) of tab-separated lines; a bad count is one, short lines are skipped."""
    parts = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split("value", "\t").alias("p"))
    return lexicon_rows(parts)


def lexicon_rows(parts: DataFrame) -> DataFrame:
    count = F.coalesce(F.try_to_number(F.get("p", F.lit(2)), F.lit("999999999")).cast("long"), F.lit(1))
    return parts.where(F.size("p") >= 2).select("ord", F.get("p", F.lit(0)).alias("deva"), F.get("p", F.lit(1)).alias("roman"), count.alias("n"))


def concatenated_json(spark: SparkSession, path: str) -> DataFrame:
    """(value) of objects that follow one another without separators."""
    import json

    import pandas as pd

    def objects(batches):
        decoder = json.JSONDecoder()
        for pdf in batches:
            for text in pdf["value"]:
                at, out = 0, []
                while at < len(text):
                    if text[at].isspace():
                        at += 1
                        continue
                    _, end = decoder.raw_decode(text, at)
                    out.append(text[at:end])
                    at = end
                yield pd.DataFrame({"value": out})

    return spark.read.text(path, wholetext=True).mapInPandas(objects, "value string")


def stub_transcripts(spark: SparkSession, n: int, frames: list[str], words: list[str]) -> DataFrame:
    """Deterministic sentences: frame and word by index arithmetic."""
    i = F.col("id")
    return spark.range(n).select("id", F.replace(F.element_at(F.array(*map(F.lit, frames)), (i % len(frames) + 1).cast("int")), F.lit("{w}"), F.element_at(F.array(*map(F.lit, words)), (F.floor(i / len(frames)) % len(words) + 1).cast("int"))).alias("text"))


# Who speaks before synthesis, the teacher's name, data sets and licences.
PENDING, TEACHER = "__pending__", "teacher_tts"
SEED_DOMAIN = "real_seed"
DATASETS = {True: ("real_seed_text", "real_seed_text_only"), False: ("synthetic_hinglish_text", "synthetic_teacher_tts")}


def corpus_rows(df: DataFrame, partition: str = "train") -> DataFrame:
    """Manifest rows of cleaned texts: (text, ref_surface, domain, source, seed_tags, seed_density, seed_bin).

    Tags, density and bin of a seed are carried where it has tags and a known bin (a null density is worked out from
    the carried tags); otherwise they follow from the text.
    """
    trusted = F.coalesce(F.size("seed_tags") > 0, F.lit(False)) & F.coalesce(F.col("seed_bin").isin(*BINS), F.lit(False))
    tags = F.when(trusted, F.col("seed_tags")).otherwise(C.language_tags(F.col("text")))
    measured = C.let(tags, lambda t: F.struct(t.alias("tags"), C.mixing_bin(C.mixing_index(t)).alias("bin"), C.switch_density(t).alias("density")))
    repeats = C.let(C.tokens(F.col("text")), lambda w: C.ngram_repetition(w, 4))
    rows = df.withColumn("__real", F.coalesce(F.col("domain") == SEED_DOMAIN, F.lit(False))).withColumn("__m", measured).withColumn("__rep", repeats)
    own_bin, density = F.col("__m.bin"), F.coalesce(F.when(trusted, F.col("seed_density")), F.col("__m.density"))
    by_origin = lambda i: F.when(F.col("__real"), DATASETS[True][i]).otherwise(DATASETS[False][i])
    cid = C.corpus_id(F.col("text"))
    none = lambda name: F.lit(None).alias(name)
    made = rows.select(
        cid.alias("utt_id"), none("audio_path"), F.col("text").alias("ref_orig"), "ref_surface", none("ref_iso15919"), F.when(trusted, F.col("seed_bin")).otherwise(own_bin).alias("cmi_bin"),
        density.alias("cs_density"), F.col("__m.tags").alias("lang_tags"), F.lit(PENDING).alias("speaker_id"), none("duration_s"), none("sha256"), by_origin(0).alias("dataset"), F.lit(partition).alias("partition"),
        (~F.col("__real")).alias("is_synthetic"), by_origin(1).alias("license"), F.array(F.concat(F.lit("domain:"), "domain"), F.concat(F.lit("source:"), "source")).alias("flags"),
        cid.alias("corpus_id"), F.lit(TEACHER).alias("teacher"), F.col("__rep").alias("rep_4gram"),
    )
    return conform(made)


def anchored(df: DataFrame) -> DataFrame:
    """Real rows made complete: not synthetic, in train, with a corpus id (their own or the text's) and all optional columns."""
    own = F.nullif("corpus_id", F.lit("")) if "corpus_id" in df.columns else F.lit(None).cast("string")
    text = F.nullif("ref_orig", F.lit(""))
    rows = df.withColumns({"corpus_id": F.coalesce(own, F.when(text.isNotNull(), C.corpus_id(text))), "is_synthetic": F.lit(False), "partition": F.lit("train")})
    return conform(rows)


def speech_requests(plan: DataFrame, most: int = 250, rate: int = 24_000) -> DataFrame:
    """A dry run of synthesis: (utt_id, body, seconds, problem) for plan rows (utt_id, text, voice, speed); nothing is sent.

    `body` is the request as JSON, `seconds` the length of the silent stand-in clip.
    """
    body = F.to_json(F.struct("text", F.col("voice").alias("voice_id"), F.lit(rate).alias("sample_rate"), F.lit("wav").alias("output_format"), "speed"))
    problem = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.char_length("text") > most, "too_long")
    return plan.select("utt_id", F.when(problem.isNull(), body).alias("body"), F.when(problem.isNull(), F.greatest(F.lit(1.0), F.char_length("text") / 15.0)).alias("seconds"), problem.alias("problem"))


def markdown_page(title: str, **tables: DataFrame) -> str:
    """One page with a heading and a table for each (small) report."""
    cell = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in df.collect())]
        out += ["", f"## {name.replace('_', ' ')}", "", *("| " + " | ".join(r) + " |" for r in rows)]
    return "\n".join(out) + "\n"
