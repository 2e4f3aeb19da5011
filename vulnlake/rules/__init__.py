"""Rule tables. Their size is fixed, so the frames built from them are broadcast."""
