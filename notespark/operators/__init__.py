"""DataFrame-to-DataFrame operators; all lazy unless their docstring says otherwise."""
