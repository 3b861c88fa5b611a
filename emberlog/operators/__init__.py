"""DataFrame operators: normalise, build features, detect, tag, query, correlate, triage."""
