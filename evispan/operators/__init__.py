"""Evidence-selection engine: operators."""
