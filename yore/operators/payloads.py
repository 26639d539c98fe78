"""Payloads from rows: nodes, media, the owner, mails, and what every payload of a source gets. All but one are column expressions; to_json leaves out what is null."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.functions.times import is_instant, iso

#: The namespace of what the mail protocol itself names.
MAIL = "email"


def node(kind: str | Column, key: list[str], **fields: Column) -> Column:
    """A node: its type, the fields that identify it, and its fields; one named by a Python word takes _ at its end."""
    told = [v.alias(k.rstrip("_")) for k, v in fields.items()]
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("@type"), F.array(*map(F.lit, key)).alias("@key"), *told)


def media_type(mime: Column, kind: Column | None = None) -> Column:
    """ImageObject, AudioObject, VideoObject or DocumentObject: the kind that is given, else what the mime type says, else a document."""
    first = F.initcap(F.regexp_extract(F.lower(mime), r"^(image|audio|video)/", 1))
    found = F.when(F.coalesce(first, F.lit("")) != "", F.concat(first, F.lit("Object"))).otherwise("DocumentObject")
    return found if kind is None else F.coalesce(kind, found)


def media(mime: Column, kind: Column | None = None, url: Column | None = None, data: Column | None = None, path: Column | None = None, **fields: Column) -> Column:
    """A media node, identified by its url. data: base64, alone or as a data URI; sources.attachments moves it and what a path holds out of the payload."""
    if data is not None:
        head = F.concat(F.lit("data:"), F.coalesce(mime, F.lit("application/octet-stream")), F.lit(";base64,"))
        fields["contentData"] = F.when(data.startswith("data:"), data).otherwise(F.concat(head, data))
    if url is not None:
        fields["url"] = url
    if path is not None:
        fields["contentPath"] = path
    return node(media_type(mime, kind), ["url"], mimeType=mime, **fields)


def own(source: str, source_id: Column | None = None, handle: Column | None = None, kind: str = "Person", same: list[str] | None = None, **fields: Column) -> Column:
    """The store's owner as a source knows them: by an id, else a handle, else as the only one of the source."""
    named = {"sourceId": source_id} if source_id is not None else {"handle": handle} if handle is not None else {}
    extra = {"handle": handle} if source_id is not None and handle is not None else {}
    return node(kind, ["@type", "source", *named], source=F.lit(source), **named, **extra, **fields, sameAs=F.array(*map(F.lit, [*(same or []), "@me"])))


def _person(address: Column, name: Column, me: list[str]) -> Column:
    at = F.lower(address)
    mine = at.isin([x.lower() for x in me]) if me else F.lit(False)
    return node("Person", ["source", "handle"], source=F.lit(MAIL), handle=at, name=name, sameAs=F.when(mine, F.array(F.lit("@me"))))


def bare_id(message_id: Column) -> Column:
    """A Message-ID without its angle brackets."""
    return F.regexp_replace(message_id, r"^<(.*)>\z", "$1")


def mails(rows: DataFrame, me: list[str], body: str = "payload") -> DataFrame:
    """rows with the sending of each mail as a payload; null where nothing identifies the mail or it has no sender or time.

    rows: message_id, at (milliseconds), sender and recipients (struct, array of struct: address, name), subject, text,
    reply_to (the id of what it answers), tags (array). A mail is its Message-ID in the protocol's own namespace, so that
    every source of it gives the same node; without one it is its sender, time and subject. People are their addresses,
    in lower case and each once; the ones in `me` are the owner.
    """
    sender, mid = F.col("sender.address"), bare_id(F.nullif(F.trim("message_id"), F.lit("")))
    sent = iso(F.col("at"))
    own_id = F.concat_ws(":", F.lit(MAIL), F.sha2(F.concat_ws("\u001f", F.lower(sender), sent, F.coalesce("subject", F.lit(""))), 256))
    others = F.transform(F.filter("recipients", lambda r: r["address"].isNotNull()), lambda r: F.struct(F.lower(r["address"]).alias("address"), r["name"].alias("name")))
    once = F.filter(F.transform(others, lambda r, i: F.struct(r.alias("r"), F.coalesce(F.array_position(F.transform(others, lambda x: x["address"]), r["address"]), F.lit(0)).alias("first"), i.alias("i"))), lambda x: x["first"] == x["i"] + 1)
    people = F.transform(once, lambda x: _person(x["r"]["address"], x["r"]["name"], me))
    answered = F.when(F.col("reply_to").isNotNull(), F.array(node("Message", ["source", "sourceId"], source=F.lit(MAIL), sourceId=bare_id(F.col("reply_to")))))
    plain = dict(source=F.lit(MAIL), sourceId=mid, name=F.col("subject"), text=F.nullif(F.col("text"), F.lit("")), inReplyTo=answered, tags=F.when(F.size("tags") > 0, F.col("tags")))
    message = node("Message", ["source", "sourceId"], **plain).withField("`@id`", F.when(mid.isNull(), own_id))
    action = F.struct(
        F.lit("MessageAction").alias("@type"), F.concat(F.lit("sent:"), F.coalesce(F.concat(F.lit(f"{MAIL}:"), mid), own_id)).alias("@id"), F.lit(MAIL).alias("source"), sent.alias("timestamp"),
        _person(sender, F.col("sender.name"), me).alias("agent"), F.when(F.size(people) > 0, people).alias("recipient"), message.alias("result"),
    )
    return rows.withColumn(body, F.when(sender.isNotNull() & F.col("at").isNotNull(), F.to_json(action)))


def asserted(body: Column, snapshot: bool, crawled: Column | None = None, recorded: Column | None = None) -> Column:
    """A payload with when it was asserted: as it says itself, else as its record does (recorded), else, of a snapshot, when that was taken (crawled), and of an event when it happened, if that is an instant. Times are milliseconds."""
    said = lambda name: F.get_json_object(body, f"$['{name}']")
    happened = F.coalesce(said("timestamp"), said("startTime"), said("endTime"))
    at = F.when(is_instant(happened), happened) if not snapshot else iso(crawled) if crawled is not None else F.lit(None).cast("string")
    at = F.coalesce(iso(recorded), at) if recorded is not None else at
    put = said("@assertedAt").isNull() & at.isNotNull() & body.startswith("{")
    rest = F.substring(body, F.lit(2), F.length(body))
    return F.when(put, F.concat(F.lit('{"@assertedAt":"'), at, F.when(F.trim(rest) == "}", '"').otherwise('",'), rest)).otherwise(body)


@F.pandas_udf(T.StringType())
def complete(bodies: pd.Series) -> pd.Series:
    """Payloads of a snapshot whose nodes all assert that they are whole: what a list of theirs no longer has is over. What is no JSON object stays."""

    def marked(value, root: bool = False):
        if isinstance(value, list):
            return [marked(x) for x in value]
        if not isinstance(value, dict):
            return value
        out = {k: marked(v) if k not in ("@key", "sameAs") else v for k, v in value.items()}
        if "@type" in out and not root and "*" not in (out.get("@asserts") or ()):
            out["@asserts"] = [*(out.get("@asserts") or ()), "*"]
        return out

    def one(body: str) -> str:
        try:
            told = json.loads(body)
        except ValueError:
            return body
        return json.dumps(marked(told, root=True), ensure_ascii=False) if isinstance(told, dict) else body

    return bodies.map(one, na_action="ignore")
