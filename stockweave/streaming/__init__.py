"""The covered feature set is batch only, so nothing lives here."""
