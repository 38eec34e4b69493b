"""One typed settings object passed to operators (replaces env-driven scalars)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Settings:
    # --- fixed values that must equal the reference's defaults ---------------
    chunk_width: int = 500  # characters per chunk
    write_batch_size: int = 5000  # rows per collection write batch
    k_min: int = 10  # search limit clamp, lower bound
    k_max: int = 50  # search limit clamp, upper bound
    default_n_results: int = 5  # request default for n_results
    history_limit: int = 10  # default /history and conversation-list limit
    memory_limit: int = 5  # messages of conversation memory
    max_frames: int = 100  # frames kept per video
    similarity_threshold: float = 0.9  # histogram correlation above this = duplicate
    min_brightness: float = 30.0  # mean pixel below this = irrelevant frame
    min_edges: int = 500  # edge pixels below this = irrelevant frame
    max_dimension: int = 1980  # frames larger than this are scaled down
    min_width: int = 800  # images smaller than this are scaled up
    min_height: int = 600
    min_text_confidence: float = 60.0  # OCR tokens must score strictly above this
    max_new_tokens: int = 512
    context_length: int = 8192
    temperature: float = 0.7
    top_p: float = 0.95
    repetition_penalty: float = 1.1
    behaviour_context: str | None = None  # unset system text -> empty section
    no_hit_message: str = "No relevant documents found for your query."
    # --- our own knobs -------------------------------------------------------
    embed_dim: int = 64  # dimension of the default hashed embedder
    # Upper bound (bytes) for anything we broadcast; sides above it shuffle.
    broadcast_max_bytes: int = 64 * 1024 * 1024
    # Vector blocks handed to numpy in one Arrow row (rows per block).
    block_rows: int = 1024
    # Inverted-file cells for k-NN; capped so the centroid matrix stays small.
    max_cells: int = 1024
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()
