"""Evidence-selection engine: plans."""
