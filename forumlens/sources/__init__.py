"""Tables, files and search specifications that feed the operators."""
