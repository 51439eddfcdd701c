"""Evidence-selection engine: sources."""
