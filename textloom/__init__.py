"""textloom: analytics over code-mixed text, record sets, vectors and conversations, on Spark."""
