"""Readers of the text formats: each gives a table; files of a folder are read together.

Self-contained blocks (spectra, scans, sequences) are cut by Spark's own line
separator, so large files split.  So do sectioned reports, where a line
inherits from lines above: each split is filled on its own, and the last
headings of the splits before it come over its edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def column_named(df: DataFrame, name: str) -> Column:
    """The column of that name in any case; an error if there is none."""
    for c in df.columns:
        if c.lower() == name.lower():
            return F.col(f"`{c}`")
    raise ValueError(f"no column {name}")


def peptide_proteins(rows: DataFrame, peptide: str = "peptide", protein: str = "protein", order: str = "ord") -> DataFrame:
    """(peptide, proteins): comma lists joined over rows, trimmed, in the order first seen."""
    each = rows.select(peptide, order, F.explode(F.split(protein, ",")).alias("p")).select(peptide, order, F.trim("p").alias("p")).where("p <> ''")
    first = each.groupBy(peptide, "p").agg(F.min(order).alias("_o"))
    return first.groupBy(peptide).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "p"))), lambda x: x["p"]).alias("proteins"))


def blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, ord): pieces of the files between separators; a file is told by its whole path."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("block"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"))


def stem() -> Column:
    """The name of a file without folders and ending."""
    return F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")


def peak_list(text: Column) -> Column:
    """Array of (mz, intensity) of the lines that begin with a digit."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.rlike(x, F.lit(r"^\s*[0-9]")))
    return F.transform(lines, lambda x: F.struct(F.get(F.split(F.trim(x), r"\s+"), F.lit(0)).cast("double").alias("mz"), F.get(F.split(F.trim(x), r"\s+"), F.lit(1)).cast("double").alias("intensity")))


def _last_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "ord")


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """dataset, title, scan, charge, precursor_mz, peaks; of a repeated title in a file the last block stands."""
    from modspec.functions.scalars import scan_of_title

    raw = blocks(spark, path, "END IONS").where(F.contains("block", F.lit("BEGIN IONS")))
    title = F.trim(F.regexp_extract("block", r"(?m)^TITLE=([^\r\n]*)", 1))
    rows = raw.select("file", stem().alias("dataset"), title.alias("title"), "ord",
                      F.expr(r"try_cast(regexp_extract(block, '(?m)^CHARGE=([0-9]+)', 1) as int)").alias("charge"),
                      F.regexp_extract("block", rf"(?m)^PEPMASS=\s*({NUMBER})", 1).cast("double").alias("precursor_mz"), peak_list(F.col("block")).alias("peaks"))
    # by what joins with lists of spectra go by, so that the peaks needn't move again
    return _last_wins(rows.repartition("dataset", "title"), ["dataset", "title", "file"]).select("dataset", "title", scan_of_title(F.col("title")).alias("scan"), "charge", "precursor_mz", "peaks")


def _field(name: str) -> Column:
    return F.expr(rf"try_cast(nullif(regexp_extract(block, '(?m)^I\\s+{name}\\s+({NUMBER.replace(chr(92), chr(92) * 2)})', 1), '') as double)")


def above_baseline(scans: DataFrame) -> DataFrame:
    """Scans with their baseline and without the peaks below it."""
    from modspec.functions.scalars import baseline_of

    rated = scans.withColumn("baseline", baseline_of(F.transform("peaks", lambda p: p["intensity"])))
    # the power of a logarithm may end a little above the value that it came from
    return rated.withColumn("peaks", F.filter("peaks", lambda p: p["intensity"] >= F.col("baseline") * (1 - 1e-12)))


def read_ms1(spark: SparkSession, path: str) -> DataFrame:
    """run, scan, rt_min, injection_ms, peaks, baseline: scans with positive peaks over at least 10 m/z; files of profile data are rejected.

    Peaks below the scan's baseline (``baseline_of``) are dropped.
    """
    raw = blocks(spark, path, "\nS\t")
    run = stem()
    profile = raw.where(F.rlike("block", F.lit(r"(?m)^H\s+DataType\s+P"))).select("file").distinct()
    scans = raw.join(profile, "file", "left_anti").where(F.rlike("block", F.lit(r"^(S\t)?\s*[0-9]+\s")) & ~F.rlike("block", F.lit("^H")))
    body = F.regexp_replace("block", r"^[^\r\n]*\r?\n?", "")
    rows = scans.select(run.alias("run"), F.regexp_extract("block", r"([0-9]+)", 1).cast("long").alias("scan"), (_field("RetTime") / 60).alias("rt_min"), _field("IonInjectionTime").alias("injection_ms"), F.filter(peak_list(body), lambda p: p["intensity"] > 0).alias("peaks"))
    mzs = F.transform("peaks", lambda p: p["mz"])
    return above_baseline(rows.where((F.size("peaks") > 0) & (F.array_max(mzs) - F.array_min(mzs) >= 10)))


def read_ms2_map(spark: SparkSession, path: str) -> DataFrame:
    """run, ms1_scan, ms2_scan of blocks with both numbers."""
    raw = blocks(spark, path, "\nS\t")
    pair = raw.select(stem().alias("run"), F.expr("try_cast(nullif(regexp_extract(block, '^(?:S\\\\t)?\\\\s*([0-9]+)', 1), '') as bigint)").alias("ms2_scan"), _field("PrecursorScan").cast("long").alias("ms1_scan"))
    return pair.where("ms2_scan is not null and ms1_scan is not null").select("run", "ms1_scan", "ms2_scan")


def fasta_rows(raw: DataFrame, name_regex: str | None = None) -> DataFrame:
    """protein, sequence of records (block, ord), with or without their ``>``; of a repeated name the last stands."""
    block = F.regexp_replace("block", r"^\s*>", "")
    rows = raw.withColumn("block", block).where(F.trim("block") != "")
    header = F.trim(F.regexp_extract("block", r"^([^\r\n]*)", 1))
    name = F.coalesce(F.nullif(F.regexp_extract(F.concat(F.lit(">"), header), name_regex, 1), F.lit("")), header) if name_regex else header
    named = rows.select(name.alias("protein"), F.regexp_replace(F.regexp_replace("block", r"^[^\r\n]*", ""), r"\s", "").alias("sequence"), "ord")
    return _last_wins(named, ["protein"])


def read_fasta(spark: SparkSession, path: str, name_regex: str | None = None) -> DataFrame:
    """protein, sequence: the name is the first group of the pattern in the header line, else the header; of a repeated name the last stands.

    Records begin with ``>`` at the start of a line; one inside a header is part of it.
    """
    return fasta_rows(blocks(spark, path, "\n>"), name_regex)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, _run, n, line): the lines of files; _run is the byte where a line's split begins, n rises within a split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_run"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r$", "").alias("line"))


def _sections(lines: DataFrame, fills: dict[str, Column]) -> DataFrame:
    """Lines with the last non-null value of each expression at or before them in their file.

    No task has more than one split of a file; a compressed file is one split.
    """
    from modspec.operators.windows import over_runs

    return over_runs(lines, ["file"], ["n"], fills)


def read_pep_spec(spark: SparkSession, path: str) -> DataFrame:
    """peptide, dataset, title: a line of one token opens a peptide, lines of two are its spectra.

    Tokens of a line with tabs are parted by tabs, so that titles may hold blanks.
    """
    rows = _lines(spark, path).where(F.trim("line") != "").withColumn("t", F.when(F.contains("line", F.lit("\t")), F.split(F.trim("line"), r"\t+")).otherwise(F.split(F.trim("line"), r"\s+")))
    filled = _sections(rows, {"peptide": F.when(F.size("t") == 1, F.col("t")[0])})
    return filled.where("size(t) = 2").select("peptide", F.col("t")[0].alias("dataset"), F.col("t")[1].alias("title"))


def read_msms_report(spark: SparkSession, path: str) -> DataFrame:
    """peptide, dataset, title, imp, abundance; peptides and spectra without forms vanish."""
    rows = _lines(spark, path).where(F.trim("line") != "").withColumn("t", F.split("line", "\t"))
    kind = F.col("t")[0]
    filled = _sections(rows, {"peptide": F.when(kind == "P", F.get("t", F.lit(1))), "spec": F.when(kind == "S", F.struct(F.get("t", F.lit(1)).alias("d"), F.get("t", F.lit(2)).alias("n")))})
    return filled.where(~kind.isin("P", "S")).select("peptide", F.col("spec.d").alias("dataset"), F.col("spec.n").alias("title"), kind.alias("imp"), F.get("t", F.lit(1)).cast("double").alias("abundance"))


def read_site_report(spark: SparkSession, path: str) -> DataFrame:
    """site, imp, charge, run, area of the ``*`` lines under each site line."""
    rows = _lines(spark, path).where(F.trim("line") != "").withColumn("t", F.split("line", "\t"))
    filled = _sections(rows, {"site": F.when(F.col("t")[0] != "*", F.col("t")[0])})
    return filled.where(F.col("t")[0] == "*").select("site", F.col("t")[1].alias("imp"), F.col("t")[2].alias("charge"), F.col("t")[3].alias("run"), F.element_at("t", -1).cast("double").alias("area"))


def mod_library_rows(lines: DataFrame) -> DataFrame:
    """full_name, name, specificity, residues, pos_class, mono_mass, avg_mass of lines ``Name[Spec]=RESIDUES CLASS mono avg ...``."""
    value = F.split(F.regexp_extract("line", r"^[^=]+=(.*)$", 1), r"\s+")
    rows = lines.where(F.rlike("line", F.lit(r"^[^=\[]+\[[^\]]*\]=\S+ (NORMAL|PEP_N|PEP_C|PRO_N|PRO_C) ")))
    full = F.regexp_extract("line", r"^([^=]+)=", 1)
    return rows.select(full.alias("full_name"), F.regexp_extract(full, r"^([^\[]+)", 1).alias("name"), F.regexp_extract(full, r"\[([^\]]*)\]", 1).alias("specificity"), value[0].alias("residues"), value[1].alias("pos_class"), value[2].cast("double").alias("mono_mass"), value[3].cast("double").alias("avg_mass"))


def read_mod_library(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a modification library file; an error where their number isn't what its ``total=`` line says."""
    lines = _lines(spark, path)
    rows = mod_library_rows(lines)
    said = lines.select(F.expr(r"try_cast(nullif(regexp_extract(line, '^total=\\s*([0-9]+)', 1), '') as long)").alias("n")).agg(F.sum("n")).first()[0]
    if said is not None and said != (n := rows.count()):
        raise ValueError(f"the library has {n} readable modifications, its total is {said}")
    return rows


#: Numeric columns of a table of matches, by name in lower case.
PSM_NUMBERS = {"calc_neutral_pepmass": "double", "precursor_neutral_mass": "double", "massdiff": "double", "num_match_ions": "int", "score": "double"}


def read_psm_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of matches with a header; ``peptide`` and ``protein`` are found in any case, rows with a blank peptide dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    column_named(raw, "protein")
    kept = raw.where(F.trim(F.coalesce(column_named(raw, "peptide"), F.lit(""))) != "")
    return kept.select(*[F.col(f"`{c}`").try_cast(PSM_NUMBERS.get(c.lower(), "string")).alias(c.lower() if c.lower() in ("peptide", "protein") else c) for c in raw.columns])


def read_ms2(spark: SparkSession, path: str) -> DataFrame:
    """run, ms2_scan, ms1_scan, precursor_mz, charge, rt_min, activation, instrument, peaks, baseline, fragmentation; more than one Z line gives charge 0.

    Peaks below the scan's baseline are dropped; ``fragmentation`` is null for other methods than those of ``fragmentation_code``.
    """
    from modspec.functions.scalars import fragmentation_code
    from modspec.operators.windows import drop_consecutive_repeats

    raw = blocks(spark, path, "\nS\t").where(F.rlike("block", F.lit(r"^(S\t)?\s*[0-9]+\s")))
    zs = F.regexp_extract_all("block", F.lit(r"(?m)^Z\s+([0-9]+)"), F.lit(1))
    word = lambda name: F.nullif(F.regexp_extract("block", rf"(?m)^I\s+{name}\s+(\S+)", 1), F.lit(""))
    head = F.split(F.regexp_replace(F.regexp_extract("block", r"^([^\r\n]*)", 1), r"^S\t", ""), r"\s+")
    rows = raw.select(
        "file", stem().alias("run"), head[0].cast("long").alias("ms2_scan"), _field("PrecursorScan").cast("long").alias("ms1_scan"), F.element_at(head, -1).cast("double").alias("precursor_mz"),
        F.when(F.size(zs) == 1, F.get(zs, F.lit(0)).cast("int")).otherwise(0).alias("charge"), (_field("RetTime") / 60).alias("rt_min"), word("ActivationType").alias("activation"), word("InstrumentType").alias("instrument"),
        F.filter(peak_list(F.regexp_replace("block", r"^[^\r\n]*\r?\n?", "")), lambda p: p["intensity"] > 0).alias("peaks"), "ord")
    once = above_baseline(drop_consecutive_repeats(rows, ["file"], ["ord"], "ms2_scan").drop("ord", "file"))
    return once.withColumn("fragmentation", fragmentation_code(F.col("activation"), F.col("instrument")))


def read_peptide_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(imp_rows, rt_ranges) of a peptide report.

    Protein lines, ``*`` rows (form, charge, run, three m/z, area) and ``@`` rows
    (start, end, ratio, label); of a repeated form, charge and run the last row
    stands, and one without ``@`` rows drops out.  Title lines are told by what
    they say, so a report may come in one file or in many.  A ``*`` row has its
    three keys at least, and a protein line no two tabs.
    """
    from modspec.operators.windows import over_runs
    from modspec.sources.store import stored, written

    # a block is a form's row without its star, its ranges, and what heads the next one
    text = spark.read.option("lineSep", "\n*\t").text(path)
    title = lambda x: F.rlike(x, F.lit(r"^(Protein_name,Peptide_start_position_on_protein|IMP\t|@\tRT_start\t)"))
    lines = F.filter(F.split(F.regexp_replace("value", r"^\*\t", ""), r"\r?\n|\r$"), lambda x: (F.trim(x) != "") & ~title(x))
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_run"), F.monotonically_increasing_id().alias("n"), lines.alias("l"))
    first = F.split(F.get("l", F.lit(0)), "\t")
    own = F.coalesce((F.size(first) >= 3) & (first[0] != "@"), F.lit(False))
    at = lambda x: F.startswith(x, F.lit("@\t"))
    heads = F.filter("l", lambda x, i: ~at(x) & ((i > 0) | ~own))
    key = ["imp", "charge", "run"]
    blocks_of = raw.select("file", "_run", "n", F.when(own, first).alias("s"), F.filter("l", at).alias("ranges"), F.get(heads, F.size(heads) - 1).alias("head"))
    forms = blocks_of.where("s is not null and size(ranges) > 0").select("file", "_run", "n", *[F.col("s")[i].alias(c) for i, c in enumerate(key)], "s", "ranges")
    # the last of a split first, in numbers, which need no sort; written, so that Spark knows whether it is small
    last = written(forms.groupBy("file", "_run", *key).agg(F.max("n").alias("n")).groupBy(*key).agg(F.max(F.struct("file", "_run", "n")).alias("last")))
    kept = stored(forms.join(last, key).where("file = last.file and _run = last._run and n = last.n").drop("last"))
    # only the forms that stay and the headings are put in order
    side = lambda df, n: df.select("file", "_run", "n", F.lit(n).alias("_side"), *([*key, "s"] if n == 0 else [F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in [*key, "s"]]), ("head" if n else F.lit(None).cast("string").alias("head")))
    filled = over_runs(side(kept, 0).unionByName(side(blocks_of.where("head is not null"), 1)), ["file"], ["n", "_side"], {"protein_line": F.col("head")}).where("_side = 0")
    number = lambda c, i: F.get(c, F.lit(i)).cast("double")
    imps = filled.select("protein_line", *key, *[number(F.col("s"), i).alias(n) for i, n in ((3, "mz_mid"), (4, "mz_lo"), (5, "mz_hi"), (6, "area"))])
    each = kept.select(*key, F.explode("ranges").alias("r")).select(*key, F.split("r", "\t").alias("t"))
    ranges = each.select(*key, *[number(F.col("t"), i).alias(n) for i, n in ((1, "rt_start"), (2, "rt_end"), (3, "ratio"))], F.get("t", F.lit(4)).cast("int").alias("check_label"))
    return imps, ranges


def read_pair_report(spark: SparkSession, path: str) -> DataFrame:
    """pair, site, imp, charge, q_left, q_right; the site stands on the first row of its block only, the file's name is the pair."""
    nth = F.row_number().over(Window.partitionBy("file", "_run").orderBy("n"))
    rows = _lines(spark, path).withColumn("_nth", nth).where("not (_run = 0 and _nth = 1)").where(F.trim("line") != "").withColumn("t", F.split("line", "\t"))
    filled = _sections(rows, {"site": F.nullif(F.col("t")[0], F.lit(""))})
    return filled.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("pair"), "site", F.col("t")[1].alias("imp"), F.col("t")[2].alias("charge"), F.col("t")[3].cast("double").alias("q_left"), F.col("t")[4].cast("double").alias("q_right"))


#: Digits of a string of modification numbers by place.
PLACE_DIGITS = "123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def search_dat_rows(lines: DataFrame) -> DataFrame:
    """Matches of search-engine result files given by line: file, ord (any order within a file), line.

    file, dataset, scan, spectrum, charge, calc_neutral_pepmass,
    precursor_neutral_mass, massdiff, num_match_ions, peptide, protein,
    modification, modificationlocation, score.  Only rank-1 rows with up to
    five missed cleavages count.  Places are 1-based, 0 is the N-terminus;
    fixed modifications stand first, at places without a variable one; without
    any both columns are ``-``.  A match whose query has no section drops out.

    Match rows need no context.  Only headings, titles and charges, three short
    lines a spectrum, are put in order, file by file, or split by split where
    the lines say their split (_run).
    """
    from modspec.functions.scalars import decode_title, scan_of_title
    lines = lines.select("file", F.col("_run") if "_run" in lines.columns else F.lit(0).alias("_run"), "ord", F.regexp_replace("line", r"\r$", "").alias("line"))
    named = lambda name: F.min_by(F.substr("line", F.lit(len(name) + 2)), F.when(F.startswith("line", F.lit(f"{name}=")), F.col("ord")))
    heads = lines.where(F.rlike("line", F.lit("^(MODS|FILE|IT_MODS)="))).groupBy("file").agg(named("MODS").alias("_fixed"), named("FILE").alias("_source"), named("IT_MODS").alias("_variable"))
    heads = heads.select("file", F.split(F.coalesce("_fixed", F.lit("")), ",").alias("_fixed"), F.substring_index(F.substring_index("_source", "=", -1), "\\", -1).alias("dataset"), F.split(F.coalesce("_variable", F.lit("")), ",").alias("_variable"))

    query = lambda pattern: F.expr(f"try_cast(nullif(regexp_extract(line, '{pattern}', 1), '') as bigint)")
    match = lines.where(F.rlike("line", F.lit("^q[0-9]+_p1=[0-5]"))).withColumn("_query", query("^q([0-9]+)_p1=")).withColumn("_c", F.split(F.substring_index("line", ";", 1), ","))
    part = lambda i: F.get("_c", F.lit(i))
    names = F.transform(F.regexp_extract_all(F.regexp_extract("line", "^[^;]*;(.*)$", 1), F.lit('"([^"]*)"'), F.lit(1)), lambda x: F.substring_index(x, " ", 1))
    match = match.select("file", "_query", *[part(i).try_cast(t).alias(n) for i, t, n in ((1, "double", "calc_neutral_pepmass"), (2, "double", "massdiff"), (3, "int", "num_match_ions"), (4, "string", "peptide"), (6, "string", "_places"), (7, "double", "score"))], F.array_join(names, ",").alias("protein"))

    marked = lines.where(F.rlike("line", F.lit('^(Content-Type:.*name="|title=|charge=)')))
    # any heading ends the section of a query
    filled = _sections(marked.withColumnRenamed("ord", "n"), {"_query": F.when(F.startswith("line", F.lit("Content-Type:")), F.coalesce(query('name="query([0-9]+)"'), F.lit(-1)))})
    spectra = filled.withColumnRenamed("n", "ord").where("_query >= 0").groupBy("file", "_query").agg(decode_title(named("title")).alias("spectrum"), query_charge(named("charge")).alias("charge"))

    m = match.join(heads, "file", "left").join(spectra, ["file", "_query"])
    each = lambda text: F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: i <= F.length(text))
    m = m.withColumn("_var", F.filter(F.transform(each("_places"), lambda i: F.struct((i - 1).alias("at"), F.instr(F.lit(PLACE_DIGITS), F.substr("_places", i, F.lit(1))).alias("mod"))), lambda x: x["mod"] > 0))
    m = m.withColumn("_var", F.transform("_var", lambda x: F.struct(x["at"].alias("at"), F.get("_variable", x["mod"] - 1).alias("mod"))))
    residue = lambda mod: F.regexp_extract(mod, r"^[^ ]* \(([^ ])\)", 1)
    of = lambda mod: F.concat(
        F.transform(F.filter(each("peptide"), lambda j: F.substr("peptide", j, F.lit(1)) == residue(mod)), lambda j: F.struct(j.alias("at"), mod.alias("mod"))),
        F.when(F.contains(mod, F.lit("N-term")), F.array(F.struct(F.lit(0).alias("at"), mod.alias("mod")))).otherwise(F.array().cast("array<struct<at:int,mod:string>>")))
    fixed = F.filter(F.flatten(F.transform("_fixed", of)), lambda x: ~F.exists("_var", lambda v: v["at"] == x["at"]))
    m = m.withColumn("_mods", F.concat(fixed, "_var"))
    text = lambda field: F.when(F.size("_mods") == 0, "-").otherwise(F.array_join(F.transform("_mods", lambda x: x[field].cast("string")), ","))
    return m.select("file", "dataset", scan_of_title(F.col("spectrum")).alias("scan"), "spectrum", "charge", "calc_neutral_pepmass", (F.col("calc_neutral_pepmass") + F.col("massdiff")).alias("precursor_neutral_mass"), "massdiff", "num_match_ions", "peptide", "protein", text("mod").alias("modification"), text("at").alias("modificationlocation"), "score")


def query_charge(text: Column) -> Column:
    """The number of a charge such as ``2+``."""
    return F.regexp_extract(text, "^([0-9]+)", 1).try_cast("int")


def read_search_dat(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a folder of search-engine result files; see ``search_dat_rows``."""
    return search_dat_rows(_lines(spark, path).withColumn("ord", F.struct("_run", "n")))
