"""ledgerline: reconcile a catalogue of expected items with observed items on Spark."""
