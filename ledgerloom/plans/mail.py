"""Queries over mail: each page of the table as a message of nested parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.messages import bank_name
from ledgerloom.plans.registry import query
from ledgerloom.sources import mail
from ledgerloom.views import Views


def _data(text: Column) -> Column:
    return F.struct(F.translate(F.regexp_replace(F.base64(text.cast("binary")), r"\s", ""), "+/", "-_").alias("data"))


def _part(kind: str, text: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("mimeType"), _data(text).alias("body")))


def _multi(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f'{{"mimeType":"multipart/{kind}","parts":['), F.concat_ws(",", *parts), F.lit("]}"))


@query("mail_parts", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ' ' ELSE url END AS plain, sha256(html) AS html_sha256, CASE WHEN page_id % 5 = 0 THEN page_id || '.pdf,' || page_id || 'B.PDF' ELSE '' END AS pdfs,
CASE WHEN page_id % 5 = 0 THEN '%PDF' || page_id END AS content FROM pages""")
def mail_parts(v: Views):
    """The parts of messages that hold a page's HTML two or three levels down, behind other plain and HTML parts of later order."""
    n = F.col("page_id")
    plain = _part("text/plain", F.when(n % 2 == 0, " ").otherwise(F.col("url")))
    inner = _multi("alternative", plain, _part("text/html", F.col("html")), _part("text/plain", F.lit("a second plain part")))
    pdf = F.to_json(F.struct(F.lit("application/pdf").alias("mimeType"), F.concat(n, F.lit(".pdf")).alias("filename"), F.struct(F.lit("a").alias("attachmentId")).alias("body")))
    other = F.to_json(F.struct(F.lit("application/octet-stream").alias("mimeType"), F.concat(n, F.lit("B.PDF")).alias("filename"), _data(F.concat(F.lit("%PDF"), n)).alias("body")))
    held = F.when(n % 3 == 0, _multi("related", inner, _part("text/html", F.lit("<p>later</p>")))).otherwise(inner)
    payload = F.when(n % 5 == 0, _multi("mixed", held, pdf, other)).otherwise(_multi("mixed", held))
    walked = v.table("pages").select("page_id", mail.message_parts(payload).alias("p")).select("page_id", "p.*")
    return walked.select("page_id", "plain", F.sha2("html", 256).alias("html_sha256"), F.array_join(F.transform("pdfs", lambda p: p["filename"]), ",").alias("pdfs"), F.get("pdfs", F.lit(1))["content"].cast("string").alias("content"))


@query("bank_by_body", """, w AS (SELECT doc_id, ['HDFC', 'IndusInd', 'ICICI', 'Axis', 'SBI', 'Kotak', 'none'][doc_id % 7 + 1] AS w, text FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?i)hdfc|indusind|icici|axis|sbi|kotak'))
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'Own "Name" Ltd' WHEN w = 'none' THEN 'Bank Alert' ELSE w || ' Bank' END AS bank FROM w""")
def bank_by_body(v: Views):
    """Texts that name no bank themselves, with a bank's name at their end, under senders that tell little."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    word = F.get(F.array(*map(F.lit, ["HDFC", "IndusInd", "ICICI", "Axis", "SBI", "Kotak", "none"])), (n % 7).cast("int"))
    sender = F.get(F.array(F.lit(None).cast("string"), F.lit("Bank Alert"), F.lit("Bank / Service Alert <x@y.example>"), F.lit("'Own \"Name\" Ltd' <a@b.example>")), (n % 4).cast("int"))
    rows = v.table("documents").filter(~text.rlike("(?i)hdfc|indusind|icici|axis|sbi|kotak"))
    return rows.select("doc_id", bank_name(sender, F.concat_ws(" ", "text", word)).alias("bank"))
