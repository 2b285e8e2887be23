"""Table loading (SRC-*), probe views and sinks (SNK-*)."""
