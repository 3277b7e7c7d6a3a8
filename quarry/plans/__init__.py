"""Query AST, the two query languages and their lowering."""
