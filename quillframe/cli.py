"""python -m quillframe.cli COMMAND IN OUT: files in, files out, one Spark job.

Exit codes: 0, 2 for wrong use, 1 for a failure, 130 for an interruption.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .functions import extract, language, phonetic, similarity, validate
from .locales import LOCALES
from .operators import generate, matching, privacy, selector
from .parser import TextParser
from .sources import io

COLUMN_COMMANDS = ("normalize", "prepare", "mask", "fix-encoding", "phonetic", "parse-name", "parse-company", "validate-id", "language", "infer", "soundex", "anonymize", "extract")
PAIR_COMMANDS = ("compare", "compare-names", "compare-text", "similarity", "same-chars", "patterns", "diff", "diff-code")
TABLE_COMMANDS = ("find-match", "find-matches", "duplicates", "phonetic-dups", "detect", "anonymize-csv", "anonymize-dict")
MADE_COMMANDS = ("generate", "profile", "product", "id-doc", "number", "date", "key")
LISTS = ("algorithm", "presets", "locales", "strategies", "pii-types", "types", "documents")


def columns(command: str, df: DataFrame, cfg: Config, kind: str | None = None) -> DataFrame:
    """One column of texts -> the texts and what a command makes of them."""
    p, a = TextParser(cfg.get("locale")), privacy.Anonymizer(cfg.get("locale"), cfg.get("strategy"), cfg.get("seed"))
    found = lambda c: F.to_json(extract.all_kinds(c)) if kind == "all" else F.array_join(p.extract(c, kind or "emails"), ",")
    made = {
        "normalize": p.normalize, "prepare": p.prepare_for_comparison, "mask": p.mask, "fix-encoding": p.fix_encoding, "phonetic": p.reduce_phonetic, "parse-name": p.parse_name,
        "parse-company": lambda c: F.to_json(p.parse_company(c)), "validate-id": p.validate_id, "language": language.detect_language, "infer": validate.data_type_inference, "soundex": phonetic.soundex,
        "anonymize": lambda c: a.anonymize_text(c, min_confidence=cfg.get("min_confidence", 0.0))["anonymized"], "extract": found,
    }
    return df.select("value", made[command]("value").alias("result"))


def pairs(command: str, df: DataFrame, kind: str | None = None) -> DataFrame:
    """(text1, text2) -> these and what a command says of each pair."""
    if command == "compare":
        return matching.batch_compare(df, "text1", "text2").select("text1", "text2", "result.*")
    a, b = F.col("text1"), F.col("text2")
    made = {
        "compare-names": lambda: matching.compare_names(a, b), "compare-text": lambda: matching.compare_text(a, b), "similarity": lambda: similarity.similarity(a, b, kind or "levenshtein"),
        "same-chars": lambda: F.struct(matching.same_chars(a, b).alias("same_chars"), matching.same_chars_similarity(a, b).alias("similarity")), "patterns": lambda: matching.find_common_patterns(a, b),
        "diff": lambda: matching.compare_text_detailed(a, b), "diff-code": lambda: F.struct(matching.compare_code_blocks(a, b, kind or "python").alias("code")),
    }
    out = df.select("text1", "text2", made[command]().alias("r")).select("text1", "text2", "r.*")
    # structs and arrays as JSON, so that every sink takes them
    return out.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in out.dtypes])


def tables(spark: SparkSession, o, cfg: Config) -> DataFrame:
    """Commands that compare or rewrite whole files."""
    numbered = lambda path: _lines(spark, path).select(F.monotonically_increasing_id().alias("id"), "value")
    a = privacy.Anonymizer(cfg.get("locale"), cfg.get("strategy"), cfg.get("seed"))
    if o.command in ("find-match", "find-matches"):
        t, c = numbered(o.source), numbered(o.candidates)
        args = (t, c, "id", "value", "id", "value")
        got = matching.find_best_match(*args, cfg.get("threshold")) if o.command == "find-match" else matching.compare_lists(*args, o.count, cfg.get("threshold"))
        named = got.join(t.select(F.col("id").alias("target_id"), F.col("value").alias("target")), "target_id").join(c.select(F.col("id").alias("candidate_id"), F.col("value").alias("candidate")), "candidate_id", "left")
        return named.select("target", "candidate", "score")
    if o.command == "duplicates":
        return matching.detect_duplicates(numbered(o.source), "id", "value", cfg.get("threshold"))
    if o.command == "phonetic-dups":
        lines = numbered(o.source)
        return matching.find_phonetic_duplicates(lines, "id", "value", cfg.get("threshold")).join(lines, "id").select("group", "value")
    if o.command == "detect":
        return _lines(spark, o.source).select("value", F.explode(a.detect("value")).alias("e")).select("value", "e.*")
    if o.command == "anonymize-dict":
        return a.anonymize_records(io.read_json(spark, o.source))
    return a.anonymize_columns(io.read_csv(spark, o.source, o.delimiter))


def made(spark: SparkSession, o, cfg: Config) -> DataFrame:
    """Commands that make values."""
    if o.command == "generate":
        return generate.batch(spark, o.kind or "name", o.count, cfg.get("locale"), cfg.get("seed"))
    g = generate.Generator("id", cfg.get("locale"), cfg.get("seed"))
    ids = spark.range(o.count)
    if o.command in ("profile", "product"):
        return ids.select("id", (g.profile_data() if o.command == "profile" else g.product_full()).alias("r")).select("id", "r.*")
    value = {
        "id-doc": g.id_document, "number": lambda: g.random_number(o.kind or "integer", mask=o.mask), "date": lambda: g.date(mask=o.mask), "key": g.unique_key,
    }[o.command]
    return ids.select("id", value().alias("value"))


def listed(spark: SparkSession, command: str, cfg: Config) -> DataFrame:
    """What there is to choose from."""
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    if command == "algorithm":
        return selector.all_use_cases(spark)
    if command == "presets":
        rows = [(k, *fn().to_dict().values()) for k, fn in matching.PRESETS.items()]
        return spark.createDataFrame(rows, ["preset", *matching.DEFAULT.to_dict()])
    if command == "locales":
        return spark.createDataFrame([(v.code, v.country, v.language, v.currency) for v in LOCALES.values()], "code string, country string, language string, currency string")
    if command == "documents":
        return one("document", LOCALES[cfg.get("locale")].documents if cfg.get("locale") in LOCALES else [])
    return one(*{"strategies": ("strategy", privacy.STRATEGIES), "pii-types": ("pii_type", privacy.TYPES), "types": ("type", generate.generators())}[command])


def _lines(spark: SparkSession, path: str | None) -> DataFrame:
    """Lines of files; of the standard input for '-' or nothing (which is the driver's own, read whole)."""
    if path in (None, "-"):
        return spark.createDataFrame([(x.rstrip("\r\n"),) for x in sys.stdin if x.strip()], "value string")
    return io.read_lines(spark, path)


def show(out: DataFrame, how: str | None) -> None:
    """To the screen: a table, JSON lines, only the number of rows, or nothing."""
    if how == "quiet":
        out.write.format("noop").mode("overwrite").save()
    elif how == "summary":
        print(f"{out.count()} rows")
    elif how == "json":
        for line in out.toJSON().take(50):
            print(line)
    else:
        out.show(50, truncate=False)


def run(args: list[str], spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quillframe", fromfile_prefix_chars="@")
    ap.add_argument("command", choices=(*COLUMN_COMMANDS, "batch", *PAIR_COMMANDS, *TABLE_COMMANDS, *MADE_COMMANDS, *LISTS))
    ap.add_argument("source", nargs="?")
    ap.add_argument("target", nargs="?")
    ap.add_argument("--candidates", help="file of candidates of find-match and find-matches")
    ap.add_argument("--operation", choices=COLUMN_COMMANDS, default="normalize", help="what batch does")
    ap.add_argument("--locale")
    ap.add_argument("--strategy")
    ap.add_argument("--threshold", type=float)
    ap.add_argument("--kind")
    ap.add_argument("--mask")
    ap.add_argument("--count", type=int, default=10)
    ap.add_argument("--seed", type=int)
    ap.add_argument("--delimiter", default=",")
    ap.add_argument("--encoding", default="UTF-8")
    ap.add_argument("--format")
    ap.add_argument("--show", choices=("table", "json", "summary", "quiet"), default="table")
    ap.add_argument("--config")
    try:
        o = ap.parse_args(args)
        cfg = Config(file=o.config, locale=o.locale, strategy=o.strategy, threshold=o.threshold, seed=o.seed, format=o.format).validate()
        if o.command in ("find-match", "find-matches") and not (o.source and o.candidates):
            raise ValueError(f"{o.command} needs a file of texts and --candidates")
    except SystemExit as e:
        return int(e.code or 0)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if o.command in MADE_COMMANDS or o.command in LISTS:
            out = made(spark, o, cfg) if o.command in MADE_COMMANDS else listed(spark, o.command, cfg)
            o.target = o.target or o.source
        elif o.command in PAIR_COMMANDS:
            out = pairs(o.command, io.read_pairs(spark, o.source, o.delimiter), o.kind)
        elif o.command in TABLE_COMMANDS:
            out = tables(spark, o, cfg)
        elif o.command == "batch":
            out = columns(o.operation, io.read_lines(spark, o.source, encoding=o.encoding), cfg, o.kind)
        else:
            out = columns(o.command, _lines(spark, o.source), cfg, o.kind)
        if o.target:
            io.write(out, o.target, cfg.get("format"), "overwrite")
        else:
            show(out, o.show)
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - the command line's last resort
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
