from sparloom.cli import main

raise SystemExit(main())
