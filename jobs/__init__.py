"""Jobs that run from a command line; each is a function of a session, paths and a config."""
