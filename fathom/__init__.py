"""Evidence retrieval and corpus analytics as composable DataFrame operators."""
