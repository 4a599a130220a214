"""The query surface: search, ask, documents, graph; each returns a DataFrame or a small record."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.numbers import figures_supported
from tesserae.operators import fulltext, graph, index, vectors
from tesserae.plans.models import Models


@dataclass
class Corpus:
    """Tables of an indexed collection: chunks (chunk_id, document_id, document_title, text, char_start, heading_path, vector), graph tables."""

    chunks: DataFrame
    mentions: DataFrame | None = None
    entities: DataFrame | None = None
    cites: DataFrame | None = None
    documents: DataFrame | None = None
    models: Models = field(default_factory=Models)

    def search(self, query: str, k: int = 10, doc_ids: list[str] | None = None) -> DataFrame:
        """Hybrid search: dense and lexical rankings, fused; a filter on documents goes first for vectors, last for statistics."""
        only = None if doc_ids is None else F.col("document_id").isin(doc_ids)
        from pyspark.sql import Window

        w = Window.orderBy(F.desc("score"), "chunk_id")
        terms = fulltext.code_terms(query) if "_" in query else [query]
        lexical = fulltext.search(self.chunks, terms or [query], 50, only=only).withColumn("rank", F.row_number().over(w))
        if "vector" not in self.chunks.columns:
            return lexical.limit(k)
        vector = self.chunks.sparkSession.range(1).select(self.models.embed(F.lit(query)).alias("v")).first()[0]
        dense = vectors.dense_topk(self.chunks, vector, 50, "chunk_id", "vector", only)
        return vectors.hybrid(dense.select("chunk_id", "rank"), lexical.select("chunk_id", "rank"), k)

    def evidence(self, query: str, top_k: int = 5, doc_ids: list[str] | None = None) -> DataFrame:
        """Search, reordering for questions about users of a symbol, reranking."""
        hits = self.search(query, 50, doc_ids).join(self.chunks, "chunk_id")
        from tesserae.functions.text import is_demoted, usage_intent

        symbol = self.chunks.sparkSession.range(1).select(usage_intent(F.lit(query))).first()[0]
        if symbol:
            hits = vectors.demote(hits, is_demoted(F.col("heading_path"), F.lit(symbol)))
        return vectors.rerank(hits, self.models.rerank(F.lit(query), F.col("text")), top_k)

    def ask(self, question: str, history: list[str] | None = None, top_k: int = 5, doc_ids: list[str] | None = None) -> dict:
        """Grounded answer: claims whose chunk is among the evidence and whose large figures it supports; else a refusal."""
        query = self.models.rewrite(history or [], question)
        rows = [r.asDict() for r in self.evidence(query, top_k, doc_ids).orderBy("rank").select("chunk_id", "text").collect()]  # top_k rows
        claims = [c for c in self.models.claims(query, rows) if c["chunk_id"] in {r["chunk_id"] for r in rows}]
        if claims:
            spark = self.chunks.sparkSession
            text = {r["chunk_id"]: r["text"] for r in rows}
            df = spark.createDataFrame([(i, c["text"], text[c["chunk_id"]]) for i, c in enumerate(claims)], "i int, claim string, evidence string")
            sound = {r[0] for r in df.filter(figures_supported(F.col("claim"), F.col("evidence"))).select("i").collect()}
            claims = [c for i, c in enumerate(claims) if i in sound]
        return {"refused": not claims, "claims": claims, "evidence": [r["chunk_id"] for r in rows]}

    def get_document(self, doc: str) -> DataFrame:
        return index.of_document(self.chunks, doc)

    def list_documents(self) -> DataFrame:
        return index.identities(self.chunks).orderBy("document_id")

    def graph_neighbors(self, doc: str, limit: int = 20) -> DataFrame:
        return graph.one_hop(self.mentions, self._one(doc), limit)

    def related_documents(self, doc: str, limit: int = 8) -> DataFrame:
        return graph.related(self.mentions, self._one(doc), limit)

    def document_citations(self, doc: str) -> DataFrame:
        return graph.citations_of(self.documents, self.cites, F.lit(doc))

    def citation_paths(self, doc: str, depth: int = 3) -> DataFrame:
        return graph.citation_paths(self.cites, self._one(doc), depth)

    def entity_overview(self, name: str, k: int = 5) -> dict:
        """Identity, co-occurring entities, and passages: attested chunks, else a search in the entity's documents, else in all."""
        who, docs = graph.profile(self.entities, self.mentions, name)
        ids = self.entities.filter(F.lower("name") == name.lower()).select("entity_id")
        attested = self.chunks.join(docs.filter("chunk_id IS NOT NULL").select("chunk_id"), "chunk_id", "left_semi").limit(k)
        if attested.isEmpty():
            attested = self.search(name, k) if docs.isEmpty() else self._within(docs).search(name, k)
        return {"profile": who, "mentions": docs, "cooccurring": graph.cooccurring(self.mentions, ids), "passages": attested}

    def _within(self, docs: DataFrame) -> Corpus:
        """The same with the chunks of some documents (doc_id); statistics are then those of these chunks."""
        return replace(self, chunks=self.chunks.join(docs.select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi"))

    def _one(self, doc: str) -> DataFrame:
        return self.mentions.sparkSession.range(1).select(F.lit(doc).alias("doc_id"))
