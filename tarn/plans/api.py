"""The public endpoints as queries over a set of tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import fulltext, reconcile, relational
from tarn.streaming import changes


@dataclass
class Notes:
    """users, folders, notes, tags, notetags, conversations and messages as DataFrames; every read is held to a user.

    With ``postings`` (an index of the notes' texts by ``operators.fulltext``) a search reads no text.
    """

    tables: Mapping[str, DataFrame]

    def list_notes(self, user: str, folder: str | None = None, pinned: bool | None = None, search: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
        rows = relational.optional_filters(self.tables["notes"], user_id=user, folder_id=folder, is_pinned=pinned)
        if search:
            rows = fulltext.title_or_text(rows, search, "id", "title", "content_text", self.tables.get("postings"))
        page = relational.page(rows, [F.col("is_pinned").desc(), F.col("updated_at").desc(), F.col("id")], skip, limit)
        bridge = self.tables["notetags"].select(F.col("note_id").alias("id"), "tag_id")
        names = self.tables["tags"].select(F.col("id").alias("tag_id"), F.col("name"))
        return relational.with_names(page, bridge, names, "id", "tag_id", "name", "tags")

    def get(self, table: str, user: str, id_: str) -> DataFrame:
        return relational.lookup(self.tables[table], id=id_, user_id=user)

    def list_folders(self, user: str, skip: int = 0, limit: int = 100) -> DataFrame:
        return relational.page(relational.lookup(self.tables["folders"], user_id=user), [F.col("is_pinned").desc(), F.col("updated_at").desc(), F.col("id")], skip, limit)

    def list_tags(self, user: str) -> DataFrame:
        return relational.lookup(self.tables["tags"], user_id=user).orderBy("name", "id")

    def list_users(self, skip: int = 0, limit: int = 100) -> DataFrame:
        """Without password hashes, in order of id."""
        return relational.page(self.tables["users"].drop("hashed_password"), [F.col("id")], skip, limit)

    def list_conversations(self, user: str, skip: int = 0, limit: int = 50) -> DataFrame:
        return relational.page(relational.lookup(self.tables["conversations"], user_id=user), [F.col("updated_at").desc(), F.col("id")], skip, limit)

    def conversation(self, user: str, id_: str) -> DataFrame:
        messages = self.tables["messages"].select(F.col("conversation_id").alias("id"), F.col("created_at").alias("at"), "role", "text")
        return relational.ordered_children(self.get("conversations", user, id_), messages, "id", ["at"], ["role", "text"], "messages")

    def ingest(self, requests: DataFrame) -> tuple[Notes, DataFrame]:
        """The index after requests (doc_id, version, action, text, ...) to index or delete documents, and each request with its ``status``.

        ``documents`` holds doc_id, version and text. Stale requests are answered as such and change nothing; of
        several for one document the newest counts.
        """
        documents = self.tables["documents"]
        judged = reconcile.stale_arrivals(requests, documents)
        columns = ["doc_id", "version", "action", "text"]
        fresh = judged.where("NOT stale OR (action = 'upsert' AND stored_version IS NULL)").select(*columns)
        after = changes.apply_changes(documents.select("doc_id", "version", "text"), fresh, "doc_id", "version")
        status = F.when(F.col("stale") & F.col("stored_version").isNotNull(), "stale").when(F.col("action") == "delete", "deleted").otherwise("indexed")
        return Notes({**self.tables, "documents": after}), judged.select("doc_id", "version", "action", status.alias("status"))

    def create(self, table: str, rows: DataFrame) -> Notes:
        return Notes({**self.tables, table: self.tables[table].unionByName(rows)})

    def update(self, table: str, changes: DataFrame, columns: list[str]) -> Notes:
        return Notes({**self.tables, table: relational.partial_update(self.tables[table], changes, "id", columns)})

    def delete_folder(self, user: str, id_: str) -> Notes:
        """The folder's notes and their tag links go with it."""
        folder = self.get("folders", user, id_).select(F.col("id").alias("folder_id"))
        doomed = self.tables["notes"].join(folder, "folder_id", "left_semi").select(F.col("id").alias("note_id"))
        return Notes(
            {
                **self.tables,
                "folders": self.tables["folders"].join(folder.withColumnRenamed("folder_id", "id"), "id", "left_anti"),
                "notes": self.tables["notes"].join(folder, "folder_id", "left_anti"),
                "notetags": self.tables["notetags"].join(doomed, "note_id", "left_anti"),
            }
        )
