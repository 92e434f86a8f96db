"""Tables of the library as Spark schemas."""

from __future__ import annotations

CONTENT_TYPES = ("text", "code", "diagram", "math", "table")

BOOKS = (
    "book_id string, title string, authors array<string>, isbn string, file_hash string, default_language string, structure_source string, "
    "added_at timestamp, file_path string, publisher string, year string, description string, collection string, content_hash string"
)
CHUNKS = (
    "chunk_id string, book_id string, content string, content_type string, token_count int, section_path array<string>, sections array<string>, "
    "language string, sequence int, prev_chunk_id string, next_chunk_id string, lead_in int"
)
BLOCKS = "book_id string, block_index int, content string, content_type string, section_path array<string>, language string, source_file string"
VECTORS = "chunk_id string, embedding array<float>, book_id string, content_type string, section_path string, sequence int"

#: Version of the stored layout; a backup of a newer one is refused.
SCHEMA_VERSION = 8
