"""Redaction: the same corpus with values replaced by tokens, and the table that turns tokens back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import patterns as P
from maskline.functions import scan as X
from maskline.plans.session import ship

from .discover import with_findings


def masked(value: Column, category: Column) -> Column:
    """What a report may show of a value."""
    secret = F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(3)))
    other = F.when(F.length(value) <= 4, "***").otherwise(F.concat(F.left(value, F.lit(3)), F.lit("***"), F.right(value, F.lit(2))))
    return F.when(category == "secret", secret).otherwise(other)


def detected(df: DataFrame, text: str) -> DataFrame:
    """df with findings: credentials before personal data, earlier patterns first, no overlaps."""
    return with_findings(df, text, P.SECRETS + P.PERSONAL, 3, keep=X.long_secrets, claims=True)


def numbered(found: DataFrame, scope: list[str], known: DataFrame | None = None) -> DataFrame:
    """scope, token, value of every different value; numbers go by pattern and first place, and on from those of `known`.

    found: scope, token (the name), value, ord (array or number that orders). known: scope, token ('[NAME_n]'), value.
    """
    new = found.groupBy(*scope, F.col("token").alias("name"), "value").agg(F.min("ord").alias("ord"))
    number = F.row_number().over(Window.partitionBy(*scope, "name").orderBy("ord", "value"))
    if known is None:
        return new.select(*scope, F.concat(F.lit("["), "name", F.lit("_"), number, F.lit("]")).alias("token"), "value", "ord")
    old = known.select(*scope, F.regexp_extract("token", r"^\[(.*)_\d+\]$", 1).alias("name"), "value", F.regexp_extract("token", r"_(\d+)\]$", 1).cast("int").alias("number"))
    last = old.groupBy(*scope, "name").agg(F.max("number").alias("last"))
    both = new.join(old, [*scope, "name", "value"], "left")
    fresh = both.filter("number is null").join(last, [*scope, "name"], "left").withColumn("number", F.coalesce("last", F.lit(0)) + number)
    rows = both.filter("number is not null").select(*scope, "name", "value", "ord", "number").unionByName(fresh.select(*scope, "name", "value", "ord", "number"))
    return rows.select(*scope, F.concat(F.lit("["), "name", F.lit("_"), "number", F.lit("]")).alias("token"), "value", "ord")


def replace_all(text: Column, pairs: Column, source: str, target: str) -> Column:
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p[source], p[target]))


def scrub(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, clean_text, n_secrets, n_pii, tokens (array of token, value), for every row; each row is a scope of its own.

    A value's number is its place among the row's different values of that name. All literal occurrences are replaced,
    longer values first, so that no value is cut by a shorter one inside it. No shuffle. Null text stays null.
    """
    ship(df.sparkSession)
    return df.select(key, X.scrub(F.col(text), P.SECRETS + P.PERSONAL).alias("_s")).select(key, "_s.*")


def scrub_in_scope(df: DataFrame, scope: str, order: str, text: str = "text", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with clean_text, token table): all rows of a scope share their tokens, wherever a value was found.

    A scope is as large as one conversation or file; its values are gathered for its rows, not its texts.
    """
    found = detected(df.select(scope, order, text), text).select(scope, order, F.inline_outer("findings")).filter("kind is not null")
    found = found.select(scope, "token", "value", F.struct(order, "rank", "start").alias("ord"))
    tokens = numbered(found, [scope], known)
    pairs = tokens.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "token", "value"))).alias("_pairs"))
    clean = df.join(pairs, scope, "left").withColumn("clean_text", F.when(F.col("_pairs").isNull(), F.col(text)).otherwise(replace_all(F.col(text), F.col("_pairs"), "value", "token"))).drop("_pairs")
    return clean, tokens.select(scope, "token", "value")


TOKEN = r"\[[A-Z_]+_\d+\]"


def unmask(df: DataFrame, key: str, text: str, tokens: DataFrame) -> DataFrame:
    """df with text restored from (key, token, value); unknown tokens stay."""
    used = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("token"))
    pairs = used.join(tokens.select(key, "token", "value"), [key, "token"]).groupBy(key).agg(F.collect_list(F.struct("token", "value")).alias("_pairs"))
    restored = F.when(F.col("_pairs").isNull(), F.col(text)).otherwise(replace_all(F.col(text), F.col("_pairs"), "token", "value"))
    return df.join(pairs, key, "left").withColumn(text, restored).drop("_pairs")


def redact_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(clean rows with counts, token table) of a corpus."""
    out = scrub(df, key, text)
    return out.drop("tokens"), out.select(key, F.inline_outer("tokens")).filter("token is not null")


def semantic_view(elements: DataFrame) -> DataFrame:
    """elements (…, label, value, sensitive, vault_key) as they may be published."""
    secret = F.concat(F.lit("VAULT:"), F.coalesce(F.upper("vault_key"), F.lit("MASKED")))
    return elements.withColumn("label", F.when(~F.col("sensitive"), F.col("label"))).withColumn("value", F.when(F.col("sensitive"), secret).otherwise(F.left("value", F.lit(80))))


FAILED = "[decryption failed]"


def encrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """The columns as base64 of AES-GCM: 12 bytes of nonce, ciphertext, 16 bytes of tag."""
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c).cast("binary"), key, F.lit("GCM"))) for c in columns})


def decrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    def plain(c: str) -> Column:
        raw = F.try_to_binary(F.col(c), F.lit("base64"))
        return F.when(F.col(c).isNull(), None).otherwise(F.coalesce(F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string"), F.lit(FAILED)))

    return df.withColumns({c: plain(c) for c in columns})


def compliance_record(events: DataFrame, session: str) -> DataFrame:
    """For each session: values masked, faces masked, bytes sent in the clear, last time, and the record's SHA-256."""
    out = events.groupBy(session).agg(F.sum("masked").alias("n_masked"), F.sum("faces").alias("n_faces"), (F.sum("masked") + F.sum("faces")).alias("n_total"), F.sum("plain_bytes").alias("plain_bytes"), F.max("at").alias("at"))
    return out.withColumn("sha256", F.sha2(F.to_json(F.struct(*out.columns)), 256))


def resolve_symbols(df: DataFrame, key: str, symbol: str, vault: DataFrame, aliases: DataFrame) -> DataFrame:
    """df with value: of the normalized symbol in (key, name, value), else of its alias; '' if there is none."""
    name = F.regexp_replace(F.lower(F.trim(symbol)), "[^a-z0-9]+", "_")
    rows = df.withColumn("_name", name).join(aliases.select(F.col("alias").alias("_name"), F.col("name").alias("_other")), "_name", "left")
    own = vault.select(key, F.col("name").alias("_name"), F.col("value").alias("_own"))
    other = vault.select(key, F.col("name").alias("_other"), F.col("value").alias("_its"))
    rows = rows.join(own, [key, "_name"], "left").join(other, [key, "_other"], "left")
    return rows.withColumn("value", F.coalesce("_own", "_its", F.lit(""))).drop("_name", "_other", "_own", "_its")
