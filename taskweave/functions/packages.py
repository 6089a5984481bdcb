"""Rules over a package: image, bench, family, class, source and connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.names import blank_to_null, bench_key

# The image register.
ZETA_DIGESTS = (
    "ccc08929160ba6a33ba86c070a240f0865c75f83a20b981e6e571998b8b41c83",
    "975f115a995790786a6dbf124204433ccf77460f0277227fbdd21745388e56ca",
    "cb2fee77bd5b1bbe02471664111fae13711c2a0851147f7da987105bf015f293",
    "1e2fbc7a1278c395f1d80d97fa468429854827776b70e84e056789b0f73112c8",
    "e76ff56a791502397586f102f90902e4a1aa0f9534625605bd31e64ed9f20f24",
    "8219115ca2895f78f4a64ea6cb6b78a6d09cfb85e063bc8a27f2627bb099fdfe",
)
ASTER_IMAGES = ("f976065bf0ef919c5e259651c266967f98c8302629d3fbdc41ba2d69f8c73ebb", "real-data-v4")
SYNTHETIC_DIGESTS = (
    "dcf57c1b3362bb5ebb2ea59819c0892dc74699a3fa12a340677a317c37f4ddea",
    "f468ad6dd75dbffa092a554cd663c4be4884586315737577bbc043ad0daba83f",
    "bcae80df8a044bdd5d22af1f10fc27e975cc3f9443daf24dc30c9dc0fc20c6cf",
    "e3ab159ee9ca4cde6f53c1f694f7831aa70b01bd36df7f0c7150bda7d89f0b83",
    "52ec261ee5556238d165a0797d5a1071af6b675b7808eb7a0d2d4a382dcdbbf3",
    "1cb77ee036676d6789a086919dfa3d1023df4f4b718d2f8fd443663ee2d87db4",
)
ZETA_IMAGES = ("company-bench-private", "benchmark-base", "data-obi-rl-gym")

# Bench names, families and classes.
FAMILY_OF_BENCH = {
    "company bench zeta": "real-zeta", "company bench aster": "real-aster",
    "computer bench synth": "synthetic", "computer bench real": "real",
}
NON_CONNECTOR_BENCH = "computer bench non-connector"
CLASSES = {
    "connector": "Connector", "real connector": "Real Connector", "synthetic": "Synthetic",
    "non-connector": "Non-Connector", "companybench": "CompanyBench", "company bench zeta": "Company Bench Zeta",
}
CATEGORY_MERGE = {
    "Code": "Engineering", "Law": "Legal", "Other/unclassified": "Other", "General": "Other",
    "Company Bench Zeta": "CompanyBench",
}
DELIVERED_KIND = {
    "real-aster": "Real Aster", "real-zeta": "Real Zeta",
    "real": "Real · Aster or Zeta not recorded", "synthetic": "Synthetic",
}

# Gym names, ignored folder words and source patterns.
ZETA_GYM = r"^zeta3-sql(-gym)?$"
ASTER_GYM = r"^(github|notion|linear|outlook|email-calendar|gws)(-gym)?$"
GYM_NAME = r"-gym$|^(slack|linear|github|notion)$"
IGNORED_WORDS = ("deprecated", "partial", "dupes", "shipment", "meta", "knowledgework", "ekw", "svc")
NOT_A_BATCH_NAME = "name does not say which batch it is"
SHA256 = r"^[0-9a-f]{64}$"
SERVER_TABLE = r"(?m)^\s*\[\[\s*(?:environment\.)?mcp_servers\s*\]\]"
SERVER_INLINE = r"(?m)^\s*mcp_servers\s*=\s*\[([^\]]*)\]"
FROM_IMAGE = r"(?mi)^\x{FEFF}?\s*FROM\s+(?:--\S+\s+)*(\S+)"
TASK_TABLE_NAME = r'(?ms)^\s*\[task\]\s*$(?:(?!^\s*\[).)*?^\s*name\s*=\s*"([^"]+)"'


def _has_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def _literal(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def bench_of_image(image: Column) -> Column:
    """Which bench a base image belongs to; NULL for a plain image."""
    im = F.lower(image)
    return (
        F.when(im.isNull() | (im == ""), F.lit(None))
        .when(_has_any(im, ("aster", *ASTER_IMAGES)), F.lit("company bench aster"))
        .when(_has_any(im, SYNTHETIC_DIGESTS), F.lit("computer bench synth"))
        .when(_has_any(im, ("zeta", *ZETA_DIGESTS)), F.lit("company bench zeta"))
        .when(im.contains("real-data"), F.lit("computer bench real"))
        .when(im.contains("connectors-rl-gym"), F.lit("computer bench synth"))
        .when(_has_any(im, ZETA_IMAGES), F.lit("company bench zeta"))
        .when(im.contains("connectors-harness"), F.lit("computer bench synth"))
    )


def family_of_image(image: Column) -> Column:
    return _literal(FAMILY_OF_BENCH, bench_of_image(image))


def connector_type(connector: Column, delivered_type: Column, bench: Column) -> Column:
    """Connector or not: declared, else as delivered, else by image; else NULL."""
    return F.coalesce(
        connector,
        delivered_type,
        F.when(bench.contains("non-connector"), F.lit(False)).when(
            bench.rlike("company bench|computer bench (synth|real)"), F.lit(True)
        ),
    )


def domain_without_connector(domain: Column, is_connector: Column) -> Column:
    """(domain, domainFromName): a connector task's name says nothing of its domain."""
    moved = F.coalesce(is_connector, F.lit(False)) & (domain != "Not recorded")
    return F.struct(
        F.when(moved, F.lit("Not recorded")).otherwise(domain).alias("domain"),
        F.when(moved, domain).alias("domainFromName"),
    )


def bench_for_non_connector(connector: Column, bench: Column, was_read: Column) -> Column:
    """(bench, benchFromImage): a non-connector or plain image runs on Computer bench."""
    moved = F.coalesce(connector == F.lit(False), F.lit(False)) | (bench.isNull() & F.coalesce(was_read, F.lit(False)))
    return F.struct(
        F.when(moved, F.lit(NON_CONNECTOR_BENCH)).otherwise(bench).alias("bench"),
        F.when(moved & (bench != NON_CONNECTOR_BENCH), bench).alias("benchFromImage"),
    )


def connector_facts(text: Column) -> Column:
    """(connector, services, basis) read from a package's config text."""
    has_table = text.rlike(SERVER_TABLE)
    inline = F.regexp_extract(text, SERVER_INLINE, 1)
    has_inline = text.rlike(SERVER_INLINE)
    # Names inside each server table: the text up to the next bracket.
    blocks = F.filter(F.split(text, SERVER_TABLE), lambda _, i: i > 0)
    in_tables = F.flatten(
        F.transform(
            blocks,
            lambda b: F.regexp_extract_all(F.substring_index(b, "[", 1), F.lit(r'name\s*=\s*"([^"]+)"'), F.lit(1)),
        )
    )
    named = F.regexp_extract_all(inline, F.lit(r'name\s*=\s*"([^"]+)"'), F.lit(1))
    quoted = F.regexp_extract_all(inline, F.lit(r'"([^"]+)"'), F.lit(1))
    in_list = F.when(F.size(named) > 0, named).otherwise(quoted)
    none = F.array().cast("array<string>")

    def fact(flag, services: Column, basis: str) -> Column:
        return F.struct(
            F.lit(flag).cast("boolean").alias("connector"),
            F.array_sort(F.array_distinct(services)).alias("services"),
            F.lit(basis).alias("basis"),
        )

    # How each reading was made.
    return (
        F.when(has_table, fact(True, in_tables, "a [[mcp_servers]] table with entries"))
        .when(has_inline & (F.trim(inline) != ""), fact(True, in_list, "a non-empty mcp_servers list"))
        .when(has_inline, fact(False, none, "mcp_servers declared and empty"))
        .when(~text.contains("mcp_servers"), fact(False, none, "task.toml declares no mcp_servers at all"))
        .otherwise(fact(None, none, "mcp_servers present but not readable"))
    )


def declared_task_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TASK_TABLE_NAME, 1), F.lit(""))


def from_image(dockerfile: Column) -> Column:
    return F.nullif(F.regexp_extract(dockerfile, FROM_IMAGE, 1), F.lit(""))


def connector_names(raw: Column) -> Column:
    """Names from a connector field: a list of names or objects, or joined text."""
    objects = F.from_json(raw, "array<struct<name:string>>")
    names = F.from_json(raw, "array<string>")
    looks_list = F.ltrim(raw).startswith("[")
    has_object = raw.rlike(r"^\s*\[\s*\{")
    split_text = F.filter(F.transform(F.split(raw, r"[|,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(has_object, F.transform(objects, lambda o: F.coalesce(o["name"], F.lit(""))))
        .when(looks_list, names)
        .otherwise(split_text)
    )


def connector_count_kind(gyms: Column) -> Column:
    """``single`` or ``multi`` gyms, a name with and without -gym being one."""
    named = F.array_distinct(
        F.transform(
            F.filter(F.transform(gyms, F.lower), lambda g: g.rlike(GYM_NAME)),
            lambda g: F.regexp_replace(g, r"-gym$", ""),
        )
    )
    n = F.size(F.coalesce(named, F.array().cast("array<string>")))
    return F.when(n == 1, F.lit("single")).when(n > 1, F.lit("multi"))


def _mounts(gyms: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(gyms, lambda g: F.lower(g).rlike(pattern)), F.lit(False))


def harness_of_gyms(gyms: Column) -> Column:
    """Zeta's own SQL gym says Zeta; the others say nothing."""
    return F.when(_mounts(gyms, ZETA_GYM), F.lit("zeta"))


def delivered_harness_of_gyms(gyms: Column) -> Column:
    """Aster or Zeta, for a package already known to be Company Bench."""
    return F.when(_mounts(gyms, ZETA_GYM), F.lit("zeta")).when(_mounts(gyms, ASTER_GYM), F.lit("aster"))


def harness_of(candidates: list[Column], gyms: Column) -> Column:
    """Harness of the first image or declared bench that names a Company Bench."""
    benches = [bench_of_image(c) for c in candidates]
    named = [
        F.when(b == "company bench aster", F.lit("aster")).when(b == "company bench zeta", F.lit("zeta"))
        for b in benches
    ]
    return F.coalesce(*named, harness_of_gyms(gyms))


# How a package's image was read, first choice first, and what is said where its readings disagree.
FROM_DELIVERED = "the image in the package (delivered zip on Drive)"
FROM_ARCHIVE = "the image in the package (the archive the manifest names)"
FROM_NAME = "the image in the package"
FROM_EARLIER = "the image in the package (earlier copy on Drive)"
DISAGREE = "package versions disagree"
# What decided a family.
BY_RECORD = "the image the manifest records"
BY_MANIFEST = "the manifest"
BY_CONNECTORS = "the connectors the manifest lists"
BY_PLAIN_IMAGE = "the image in the package (no connector harness)"
BUT_SYNTHETIC = "the manifest says real, %s is synthetic"
UNSETTLED = "the manifest; the bucket holds versions of the task on different images"
UNKNOWN = "not classified: the bucket holds versions of the task on different images"


def package_family(recorded: Column, connector: Column, klass: Column, words: Column, own: Column, zeta: Column, aster: Column) -> Column:
    """(family, familyFrom): recorded image, then declared words, then the package.

    ``recorded`` is the family of the image that the manifest records. ``own`` is the package's
    own image as one value with its origin: (image, family, origin), where the origin says how
    the image was read, or that its readings disagree. ``zeta`` and ``aster`` say which gyms
    the package mounts.
    """
    image_real = F.coalesce(recorded == "real", F.lit(False))
    real = image_real | words.rlike(r"real|company\s*bench")
    origin = F.when(F.coalesce(own["origin"], F.lit(DISAGREE)) == DISAGREE, F.lit(FROM_NAME)).otherwise(own["origin"])

    def is_(family, how) -> Column:
        how = F.lit(how) if isinstance(how, str) else how
        family = family if isinstance(family, Column) else F.lit(family)
        return F.struct(family.alias("family"), how.alias("familyFrom"))

    non_connector = F.coalesce(connector == F.lit(False), F.lit(False)) | F.coalesce(klass == "Non-Connector", F.lit(False))
    none = F.lit(None).cast("string")
    # Family names.
    decided = (
        F.when(recorded != "real", is_(recorded, BY_RECORD))
        .when(non_connector, is_("non-connector", BY_MANIFEST))
        .when(words.contains("zeta"), is_("real-zeta", BY_MANIFEST))
        .when(words.contains("aster"), is_("real-aster", BY_MANIFEST))
        .when(words.contains("synth"), is_("synthetic", BY_MANIFEST))
        .when(own["family"].isin("real-aster", "real-zeta"), is_(own["family"], origin))
        .when((own["family"] == "synthetic") & ~real, is_("synthetic", origin))
        .when(own["family"] == "synthetic", is_("real", F.format_string(BUT_SYNTHETIC, origin)))
        .when(real & zeta, is_("real-zeta", BY_CONNECTORS))
        .when(real & aster, is_("real-aster", BY_CONNECTORS))
        .when(real, is_("real", F.when(image_real, F.lit(BY_RECORD)).otherwise(F.lit(BY_MANIFEST))))
        .when((own["image"] != "") & own["family"].isNull(), is_("non-connector", BY_PLAIN_IMAGE))
        .otherwise(F.struct(none.alias("family"), none.alias("familyFrom")))
    )

    def unsettled(d: Column) -> Column:
        """Where readings disagree, what the manifest alone decided says so."""
        open_ = (own["origin"] == DISAGREE) & F.coalesce(d["familyFrom"] == BY_MANIFEST, F.lit(True))
        said = F.when(d["family"].isNotNull(), F.lit(UNSETTLED)).otherwise(F.lit(UNKNOWN))
        return F.struct(d["family"].alias("family"), F.when(open_, said).otherwise(d["familyFrom"]).alias("familyFrom"))

    # One element, so that the decision is computed once and then bound.
    return F.get(F.transform(F.array(decided), unsettled), F.lit(0))


def with_package_family(
    rows: DataFrame, images: list[Column], connector: Column, klass: Column, declared: Column, package_image: Column, origin: Column, gyms: Column
) -> DataFrame:
    """Rows with ``family`` and ``family_from``.

    ``images`` are the images a manifest records, in order; the first that names
    a family other than plain real decides. ``origin`` says how ``package_image`` was read.
    The inputs are bound to columns first, so each is computed once.
    """
    read = rows.select("*", F.array(*[family_of_image(i) for i in images]).alias("_images"))
    own = F.struct(package_image.alias("image"), family_of_image(package_image).alias("family"), origin.alias("origin"))
    bound = read.select(
        "*",
        F.coalesce(F.get(F.filter("_images", lambda f: f != "real"), F.lit(0)), F.get(F.filter("_images", lambda f: f == "real"), F.lit(0))).alias("_recorded"),
        connector.alias("_connector"), klass.alias("_klass"), F.lower(F.concat_ws(" ", declared, klass)).alias("_words"), own.alias("_own"),
        _mounts(gyms, ZETA_GYM).alias("_zeta"), _mounts(gyms, ASTER_GYM).alias("_aster"),
    )
    names = ("_recorded", "_connector", "_klass", "_words", "_own", "_zeta", "_aster")
    decided = bound.withColumn("_f", package_family(*[F.col(n) for n in names]))
    return decided.select(*rows.columns, F.col("_f.family").alias("family"), F.col("_f.familyFrom").alias("family_from"))


def package_parts(path: Column) -> Column:
    """A package path as class / difficulty / [domain /] file, whatever its layout."""
    classes, levels = "|".join(CLASSES), "easier|harder"
    p = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"^/|/$", "")
    # A bench group above a counted class folder, or any other wrapper, goes.
    p = F.regexp_replace(p, rf"(?i)^[^/]+/\s*({classes})\s+\d+\s*/([^/]+/.+)$", "$1/$2")
    p = F.regexp_replace(p, rf"(?i)^(?!(?:{classes})/)[^/]+/((?:{classes}|{levels})/.+)$", "$1")
    p = F.regexp_replace(p, rf"(?i)^({levels})/({classes})/(.+)$", "$2/$1/$3")

    def capital_domain(parts: Column) -> Column:
        third = F.get(parts, F.lit(2))
        capital = F.concat(F.upper(F.substring(third, 1, 1)), F.lower(third.substr(F.lit(2), F.length(third))))
        lowered = (F.size(parts) > 3) & (third == F.lower(third))
        rest = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))
        return F.when(lowered, F.concat(F.slice(parts, 1, 2), F.array(capital), rest)).otherwise(parts)

    # One element, so that the split path is computed once and then bound.
    return F.get(F.transform(F.array(F.split(p, "/")), capital_domain), F.lit(0))


def package_class(head: Column, declared: Column, connector: Column) -> Column:
    """The class the first folder names; a bench group asks the declared bench."""
    group = F.lower(F.trim(F.regexp_replace(F.regexp_replace(head, r"\(.*?\)", ""), r"\s+\d+\s*$", "")))
    says = F.lower(F.coalesce(declared, F.lit("")))
    computer = (
        F.when(says.contains("synth"), F.lit("Synthetic"))
        .when(says.contains("real"), F.lit("Real Connector"))
        .when(connector == F.lit(False), F.lit("Non-Connector"))
        .otherwise(F.lit("Connector"))
    )
    return F.coalesce(
        _literal(CLASSES, F.lower(head)),
        F.when(group == "aster", F.lit("Aster"))
        .when(group.isin("company bench", "companybench"), F.lit("CompanyBench"))
        .when(group.isin("computer bench", "computerbench"), computer),
        head,
    )


def batch_label(name: Column) -> Column:
    """(label, reason): which batch a folder is, or why it is none."""
    flat = F.regexp_replace(F.lower(name), r"[\s_\-]+", "")
    ignored = F.coalesce(*[F.when(flat.contains(w), F.lit(w)) for w in IGNORED_WORDS])
    number = F.regexp_extract(name, r"(?i)batch\s*(\d+(?:\.\d+)?)", 1)
    series = F.when(flat.contains("companybench"), F.lit("CompanyBench ")).otherwise(F.lit("Batch "))
    none = F.lit(None).cast("string")
    return (
        F.when(
            ignored.isNotNull(),
            F.struct(
                none.alias("label"),
                F.concat(F.lit("name marks it as "), ignored, F.lit(", not a delivered batch")).alias("reason"),
            ),
        )
        .when(number == "", F.struct(none.alias("label"), F.lit(NOT_A_BATCH_NAME).alias("reason")))
        .otherwise(F.struct(F.concat(series, number).alias("label"), none.alias("reason")))
    )


def source_ref(source_uri: Column, source_version: Column, source: Column, bucket: str) -> Column:
    """(object, prefix, folder, kind) of the archive a package was cut from."""
    in_bucket = rf"^gs://{bucket}/tasks/([^/]+)/([^/]+)/[^/]+$"
    uri = F.trim(F.coalesce(source_uri, F.lit("")))
    prefix = F.nullif(F.regexp_extract(uri, in_bucket, 1), F.lit(""))
    named = F.coalesce(blank_to_null(source_uri), blank_to_null(source))
    return F.struct(
        F.coalesce(
            F.when(source_version.rlike(SHA256), source_version),
            F.nullif(F.regexp_extract(uri, r"/([0-9a-f]{64})\.zip$", 1), F.lit("")),
        ).alias("object"),
        prefix.alias("prefix"),
        F.nullif(F.regexp_extract(uri, in_bucket, 2), F.lit("")).alias("folder"),
        F.when(prefix.isNotNull(), F.lit("pipeline")).when(named.isNotNull(), F.lit("elsewhere")).alias("kind"),
    )


def package_file_keys(package_path: Column, task_id: Column, task_name: Column, original: Column) -> Column:
    """File names a task's archive can have, lower-cased and sorted."""
    declared = F.regexp_replace(F.trim(task_name), r"^(harbor|obi)/", "")
    names = F.array(
        F.substring_index(package_path, "/", -1),
        F.concat(task_id, F.lit(".zip")),
        F.when(declared != "", F.concat(declared, F.lit(".zip"))),
        original,
    )
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, F.lower), lambda n: n.isNotNull() & (n != ""))))


def merged_category(category: Column) -> Column:
    """One spelling per domain."""
    text = F.regexp_replace(category, r"(?i)^Non-Connector\s*·\s*", "")
    return F.when(category.isNull() | (category == ""), category).otherwise(
        F.coalesce(_literal(CATEGORY_MERGE, text), text)
    )


def score_bucket(bucket: Column, passes: Column) -> Column:
    """``n/4``, or not recorded."""
    return F.coalesce(
        blank_to_null(bucket), F.concat(passes.cast("string"), F.lit("/4")), F.lit("(not recorded)")
    )


def row_flags(owner_contested: Column, ambiguous: Column, unverified: Column, version_dependent: Column) -> Column:
    """What a reader must know about a row. The wording is fixed."""
    return F.array_compact(
        F.array(
            F.when(owner_contested, F.lit("owner still contested")),
            F.when(ambiguous, F.lit("contested owner")),
            F.when(unverified, F.lit("unverified")),
            F.when(version_dependent, F.lit("version dependent")),
        )
    )


def task_segment(bench: Column, connector: Column, harness: Column) -> Column:
    """The leaf segment when bench and kind are known, else the bench, else unknown."""
    company = F.when(harness.isNotNull(), F.concat(F.lit("company-"), harness)).otherwise(F.lit("company"))
    return (
        F.when(bench == "company", company)
        .when(connector, F.lit("computer-connector"))
        .when(~connector, F.lit("computer-non-connector"))
        .when(bench == "computer", F.lit("computer"))
        .otherwise(F.lit("unknown"))
    )


def domain_kind(segment: Column, domain: Column, harness: Column, count: Column, kind: Column, bench: Column) -> Column:
    """The domain, or for a connector task its harness and count, or its kind."""
    shown = F.coalesce(
        _literal({"aster": "Aster", "zeta": "Zeta"}, harness), F.lit("Company Bench")
    )
    counted = F.coalesce(
        _literal({"single": "Single connector", "multi": "Multi-connector"}, count), F.lit("connectors not read")
    )
    by_image = _literal(
        {"computer bench synth": "Synthetic", "computer bench real": DELIVERED_KIND["real"]}, bench
    )
    return (
        F.when(segment.startswith("company"), F.concat_ws(" · ", shown, counted))
        .when(segment == "computer-connector", F.coalesce(kind, by_image, F.lit("Connector")))
        .otherwise(F.coalesce(domain, F.lit("Not recorded")))
    )


def sheet_keys(*names: Column) -> Column:
    """Distinct single-namespace keys of several names."""
    return F.array_distinct(F.filter(F.array(*[bench_key(n) for n in names]), lambda k: k.isNotNull() & (k != "")))
