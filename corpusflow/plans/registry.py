"""Registry of named queries (Spark builders) and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.plans import conversation, ingest, media, oracle, retrieval, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chunk_documents": retrieval.chunk_documents,
    "chunk_documents_native": retrieval.chunk_documents_native,
    "chunk_stats": retrieval.chunk_stats,
    "hash_embed_buckets": retrieval.hash_embed_buckets,
    "hash_embed_vectors": retrieval.hash_embed_vectors,
    "query_first_chunk_embed": retrieval.query_first_chunk_embed,
    "index_rows": retrieval.index_rows,
    "index_batches": retrieval.index_batches,
    "text_search": retrieval.text_search,
    "text_search_va": retrieval.text_search_va,
    "collection_appends": retrieval.collection_appends,
    "search_json": retrieval.search_json,
    "chat_retrieval": retrieval.chat_retrieval,
    "knn_batch": retrieval.knn_batch,
    "knn_va": retrieval.knn_va,
    "knn_single": retrieval.knn_single,
    "knn_per_row_k": retrieval.knn_per_row_k,
    "knn_nested": retrieval.knn_nested,
    "knn_approx": retrieval.knn_approx,
    "knn_quantised": retrieval.knn_quantised,
    "recent_queries": conversation.recent_queries,
    "recent_conversations": conversation.recent_conversations,
    "conversation_memory": conversation.conversation_memory,
    "orphan_messages": conversation.orphan_messages,
    "conversation_join": conversation.conversation_join,
    "prompt_single": conversation.prompt_single,
    "prompt_conversation": conversation.prompt_conversation,
    "new_conversation_ids": conversation.new_conversation_ids,
    "event_frames": conversation.event_frames,
    "event_parse": conversation.event_parse,
    "no_hit_answer": conversation.no_hit_answer,
    "query_log_rows": conversation.query_log_rows,
    "generate_batch": conversation.generate_batch,
    "file_type_derivation": ingest.file_type_derivation,
    "format_dispatch_counts": ingest.format_dispatch_counts,
    "unsupported_rejects": ingest.unsupported_rejects,
    "text_newline_normalise": ingest.text_newline_normalise,
    "empty_blank_rejects": ingest.empty_blank_rejects,
    "paged_text_concat": ingest.paged_text_concat,
    "count_match_check": ingest.count_match_check,
    "dimension_check": ingest.dimension_check,
    "insert_if_absent": ingest.insert_if_absent,
    "request_defaults": ingest.request_defaults,
    "frame_stride": media.frame_stride,
    "frame_relevance": media.frame_relevance,
    "frame_cap": media.frame_cap,
    "histogram_bins": media.histogram_bins,
    "histogram_corr": media.histogram_corr,
    "sequence_dedup": media.sequence_dedup,
    "ocr_token_text": media.ocr_token_text,
    "video_text": media.video_text,
    "image_resize_plan": media.image_resize_plan,
    "frame_resize_plan": media.frame_resize_plan,
    "video_stats": media.video_stats,
    "stream_ingest": streams.stream_ingest,
    "stream_search": streams.stream_search,
    "docx_extract": streams.docx_extract,
    "csv_render": streams.csv_render,
    "stream_query_log": streams.stream_query_log,
    "turn_stream": streams.turn_stream,
    "batch_sink": streams.batch_sink,
    "paged_file_extract": streams.paged_file_extract,
    "paged_source": streams.paged_source,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.ORACLES.items() if k in QUERIES}
