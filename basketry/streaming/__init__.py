from basketry.streaming.curate import curate_stream, curated_view

__all__ = ["curate_stream", "curated_view"]
