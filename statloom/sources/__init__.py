"""Where tables come from: files, generators, random numbers; and where they go."""
