"""The engine is batch only: no operator keeps state over a stream. Any frame it takes may come from foreachBatch."""
