"""Where bytes become rows and rows bytes: the only part with code that handles one document at a time."""
