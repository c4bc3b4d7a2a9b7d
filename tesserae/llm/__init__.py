"""Training-data operators; one module each, queries in ``tesserae.llm.queries``."""
