"""Scale helpers shared by the operators: size checks, ordered work on hot keys,
exact quantiles, Gram matrices and blocked top-k scoring."""
