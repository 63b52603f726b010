"""Weights, thresholds and lookup tables of the scoring model. Results depend on each of them."""

# Penalty of one finding of each type.
WEIGHTS: dict[str, float] = {
    "ComplexMethod": 1.5, "DeepNesting": 1.2, "BumpyRoad": 0.8, "LargeMethod": 0.6, "ComplexConditional": 0.5,
    "LongParameterList": 0.4, "LargeFile": 0.3, "CognitiveComplexity": 0.8, "TypeSafetyEscape": 0.7, "MagicNumber": 0.4,
    "LowDocCoverage": 0.3, "BrainMethod": 1.2, "TestProximity": 0.5, "MessageChain": 0.5, "DataClumps": 0.5, "SATD": 0.6,
    "GodClass": 1.5, "FeatureEnvy": 0.7, "LowMaintainability": 0.3, "CodeChurn": 0.6, "DeveloperCongestion": 0.7,
    "KnowledgeLoss": 1.0, "PrimitiveObsession": 0.5, "MethodTemporalCoupling": 0.3, "DocumentationDebt": 0.5,
    "IntentClarity": 0.4, "ArchitectureDebt": 0.6, "SqlInjectionRisk": 1.5, "XssRisk": 1.5, "CommandInjectionRisk": 1.5,
    "HardcodedCredential": 2.0, "HardcodedApiKey": 2.0, "UnsafeDeserialization": 1.2, "PathTraversalRisk": 1.2,
    "DependencyVulnerability": 1.0, "AbstractionLeakage": 0.6, "HardcodedAssumption": 0.5, "MissingEdgeCase": 0.5,
    "StyleInconsistency": 0.3, "SlopsquattingRisk": 1.5, "HallucinatedPackageImport": 1.5, "AiAttributedSATD": 0.8,
    "ComplexityMassConcentration": 1.2, "LlmUnboundedCall": 1.0, "LlmUnpinnedModel": 1.0, "LlmNoSystemMessage": 1.0,
    "LlmNoStructuredOutput": 1.0, "LlmUnsetTemperature": 0.8, "SsrfRisk": 1.3, "CryptographicMisuseRisk": 1.0,
    "ExceptionHandlingAntiPattern": 0.8, "AsyncAntiPattern": 0.7, "DuplicateCode": 1.0, "SplitResidue": 0.5,
    "FragmentedCode": 0.3, "TidyOpportunity": 0.0,
}

# Category bounds, least and most score.
AI_READY, HEALTHY, PROBLEMATIC, FLOOR, CEILING = 9.5, 9.0, 6.0, 1.0, 10.0

# Detector thresholds.
THRESHOLDS: dict[str, int] = {
    "complexMethodThreshold": 10, "criticalComplexityThreshold": 20, "deepNestingThreshold": 3, "highNestingThreshold": 4,
    "criticalNestingThreshold": 5, "largeMethodLines": 50, "longParameterList": 4, "cognitiveComplexityThreshold": 15,
    "criticalCognitiveThreshold": 25, "bumpyRoadChunkThreshold": 4, "chainThreshold": 4, "booleanChainThreshold": 3,
    "atfdThreshold": 5, "wmcThreshold": 20, "largeFileLines": 500,
}

# Finding types of each dimension.
DIMENSIONS: dict[str, tuple[str, ...]] = {
    "security": ("SqlInjectionRisk", "XssRisk", "CommandInjectionRisk", "HardcodedCredential", "HardcodedApiKey", "UnsafeDeserialization", "PathTraversalRisk", "DependencyVulnerability", "SsrfRisk", "CryptographicMisuseRisk", "HallucinatedPackageImport"),
    "complexity": ("ComplexMethod", "DeepNesting", "BumpyRoad", "BrainMethod", "CognitiveComplexity", "ComplexConditional", "SplitResidue", "FragmentedCode", "ComplexityMassConcentration"),
    "maintainability": ("GodClass", "FeatureEnvy", "DataClumps", "LowMaintainability", "LargeFile", "LargeMethod", "LongParameterList", "MessageChain", "PrimitiveObsession", "SATD", "DocumentationDebt", "IntentClarity", "KnowledgeLoss", "ArchitectureDebt", "CodeChurn", "MethodTemporalCoupling", "AiAttributedSATD", "ExceptionHandlingAntiPattern", "AsyncAntiPattern"),
    "duplication": ("StyleInconsistency", "DuplicateCode"),
}

SECURITY_IN_TESTS = ("SqlInjectionRisk", "XssRisk", "CommandInjectionRisk", "HardcodedCredential", "HardcodedApiKey", "UnsafeDeserialization", "PathTraversalRisk")

# Languages by extension (as written, else lower-cased) and by whole name.
EXTENSIONS: dict[str, str] = {
    "typescript": ".ts .tsx", "javascript": ".js .jsx .mjs .cjs", "python": ".py", "java": ".java", "kotlin": ".kt .kts",
    "csharp": ".cs", "rust": ".rs", "go": ".go", "php": ".php .phtml", "ruby": ".rb .rake .gemspec", "swift": ".swift",
    "dart": ".dart", "c": ".c .h", "cpp": ".cpp .cc .cxx", "scala": ".scala", "bash": ".sh .bash .zsh", "lua": ".lua",
    "elixir": ".ex .exs", "haskell": ".hs .lhs", "r": ".r .R", "clojure": ".clj .cljs .edn", "cobol": ".cbl .cob .cobol",
    "apex": ".cls .trigger", "fsharp": ".fs .fsx", "vbnet": ".vb", "perl": ".pl .pm", "groovy": ".groovy .gvy",
    "objc": ".m .mm", "powershell": ".ps1 .psm1", "erlang": ".erl .hrl", "julia": ".jl", "ocaml": ".ml .mli",
    "zig": ".zig", "nim": ".nim .nims", "crystal": ".cr", "vue": ".vue", "yaml": ".yaml .yml", "json": ".json",
    "dockerfile": ".dockerfile", "hcl": ".tf .tfvars", "makefile": ".mk", "sql": ".sql", "html": ".html .htm",
    "css": ".css .scss .less", "markdown": ".md .mdx", "toml": ".toml",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile"}

SEVERITIES = ("low", "medium", "high", "critical")
BOTS = ("dependabot", "renovate", "github-actions", "semantic-release", "release-drafter")
